"""Chat formatting: a hidden Markov model over lines recovers who speaks, then turns are rendered canonically.

States are a role and whether the line begins a turn. A line gives the symbol of its
marker (one that names a role, one that names somebody, none) and features of its
text without the marker: length, beginning, end, first word, kinds of characters.
Emissions and transitions are counted on a bounded sample of labelled turns, written
in every dialect and, MISSING of them, without their marker. Viterbi finds the best
states; where a transcript has no marker at all, text features and transitions alone
decide. A marker is cut off its turn's text.

Turns are range-sorted by conversation and turn and cut into blocks of bounded size,
so that a conversation of any length is shared by many tasks and yet is one chain:
each block gives the best score from any state before it to any state at its end, a
pass over these small matrices alone settles the states at the cuts and which
markers count, and then every block is decoded between its known ends.

Null text counts as empty. Null roles, ids and turns: the row's role is recovered
like any other (a null turn counts as turn 0, null ids are one conversation).
Repeated rows give repeated results, extra columns are ignored, an empty table
gives an empty result. With nothing to learn from, all counts are those of smoothing.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.common import Scratch, chunks, fields, held_out, texts

ROLES = ("system", "user", "assistant")
#: A block has at most so many turns and about so many characters.
BLOCK_TURNS, BLOCK_CHARS = 256, 1 << 20
#: Labelled turns the model is counted on, of conversations in the order of their hash.
MAX_TRAIN_TURNS = 8000
#: Share of turns that are taken to have lost their marker.
MISSING = 0.01
#: The features of a line depend on each other: together they count for this share.
TEMPER = 0.3
#: Weight of the values of all lines beside those of a state's lines.
BACKGROUND = 0.2

_USER = "user|human|customer|question|prompt|instruction|input|you|q"
_ASSISTANT = "assistant|ai|bot|model|chatbot|response|answer|output|agent|gpt|a"
_SYSTEM = "system|sys|context"
_MARK = re.compile(
    rf"^\s*(?:\[\d[\d: ]*\]\s*)?(?:"
    rf"<\|(?:im_start\|>)?\s*(?P<tag>{_USER}|{_ASSISTANT}|{_SYSTEM})(?:\|>)?"
    rf"|\#{{2,4}}\s*(?P<head>{_USER}|{_ASSISTANT}|{_SYSTEM})\s*:?(?=\s|$)"
    rf"|\[\s*(?P<box>{_USER}|{_ASSISTANT}|{_SYSTEM})\s*\]\s*:?"
    rf"|(?:\*\*)?(?P<word>{_USER}|{_ASSISTANT}|{_SYSTEM})(?:\*\*)?\s*[:>](?:\*\*)?(?=\s|$)"
    rf"|(?P<name>[A-Z][\w.-]{{0,19}})\s*(?P<sign>[:>])(?=\s))[ \t]?",
    re.I,
)
_GROUPS = {w: r for r, ws in zip((1, 2, 0), (_USER, _ASSISTANT, _SYSTEM)) for w in ws.split("|")}

PLAIN, BLANK, NAMED = 0, 1, 5  # 2, 3, 4: a marker of ROLES[0], [1], [2]
#: Which markers of a transcript count: those that name a role; names with the sign >; all names; there is none.
TOLD, SHARP, NAMES, BARE = range(4)
#: Values of each feature of a line.
_SIZES = (12, 6, 8, 256, 4)
_TAILS = {"?": 1, ".": 2, ":": 3, ",": 4, "!": 5}


def line_codes(line: str) -> tuple[int, ...]:
    """Length, last character, first character, first word, share of other characters than letters."""
    t = line.strip()
    if not t:
        return (0, 0, 0, 0, 0)
    c = t[0]
    head = 1 if c.isupper() else 2 if c.islower() else 3 if c.isdigit() else 4 if c in "-*+•" else 5 if c in "\"'>“«" else 6 if c in "`#{}[]()<|" else 7
    odd = sum(not (x.isalpha() or x == " ") for x in t) / len(t)
    word = t.split(None, 1)[0].lower().strip(".,:;!?")
    return min(len(t).bit_length(), 11), _TAILS.get(t[-1], 0), head, zlib.crc32(word.encode("utf-8", "replace")) % 256, 0 if odd < 0.05 else 1 if odd < 0.15 else 2 if odd < 0.4 else 3


def markers(lines: list[str]) -> list[re.Match | None]:
    return [_MARK.match(x) if x.strip() else None for x in lines]


def _role(m: re.Match | None) -> str | None:
    return m and (m["tag"] or m["head"] or m["box"] or m["word"])


def seen_markers(found: list[re.Match | None]) -> tuple[bool, bool, bool]:
    """Whether a marker names the user or the assistant, whether a name has the sign >, whether there is any name."""
    words = [_role(m) for m in found]
    names = [m for m in found if m and m["name"]]
    return any(w and _GROUPS[w.lower()] for w in words), any(m["sign"] == ">" for m in names), bool(names) or any(words)


def style_of(told: bool, sharp: bool, named: bool) -> int:
    return TOLD if told else SHARP if sharp else NAMES if named else BARE


def symbols(lines: list[str], found: list[re.Match | None], style: int) -> list[tuple[int, int]]:
    """Each line's symbol and the length of its marker under a style."""
    out = []
    for line, m in zip(lines, found):
        if word := _role(m):
            out.append((2 + _GROUPS[word.lower()], m.end()))
        elif m and (style == NAMES or style == SHARP and m["sign"] == ">"):
            out.append((NAMED, m.end()))
        else:
            out.append((PLAIN if line.strip() else BLANK, 0))
    return out


class ChatModel:
    """Log probabilities: first state, transitions, markers and features by state. State 2r begins a turn of ROLES[r], 2r + 1 continues it."""

    def __init__(self, marks: np.ndarray, codes: list[np.ndarray], turns: np.ndarray, opens: np.ndarray):
        """Counts: (symbols, states), (values, states) of each feature, (role, next role), first roles."""
        share = lambda c: c / np.maximum(c.sum(axis=0), 1e-9)
        # a blank line goes on with its turn, whether or not the sample has any
        marks = share(marks) + 1e-4
        marks[BLANK] = np.where(np.arange(6) % 2, np.maximum(marks[BLANK], 0.05), 1e-5)
        self.marks = np.log(share(marks))
        # values that a state lacks are taken as likely as they are at all
        self.codes = [np.log((1 - BACKGROUND) * share(c) + BACKGROUND * share(c.sum(axis=1, keepdims=True) + 0.5)) for c in codes]
        lines = codes[0].sum(axis=0).reshape(3, 2) + 0.5  # of each role: turns, further lines
        nxt = (turns + 0.2) / (turns + 0.2).sum(axis=1, keepdims=True)
        move = np.empty((6, 6))
        for r in range(3):
            stay = (1 - BACKGROUND) * lines[r, 1] / lines[r].sum() + BACKGROUND * lines[:, 1].sum() / lines.sum()
            for s in range(3):
                move[2 * r : 2 * r + 2, 2 * s] = (1 - stay) * nxt[r, s]
                move[2 * r : 2 * r + 2, 2 * s + 1] = stay if r == s else 0
        first = np.zeros(6)
        first[0::2] = (opens + 0.2) / (opens + 0.2).sum()
        with np.errstate(divide="ignore"):
            self.first, self.move = np.log(first), np.log(move)

    def emissions(self, lines: list[str], found: list[re.Match | None], style: int) -> tuple[np.ndarray, list[int]]:
        """(lines, states) log probabilities and the lengths of the lines' markers."""
        marks = symbols(lines, found, style)
        codes = np.array([line_codes(x[n:]) for x, (_, n) in zip(lines, marks)], dtype=np.int64)
        out = TEMPER * sum(table[codes[:, k]] for k, table in enumerate(self.codes))
        seen = np.array([m for m, _ in marks])
        if style != BARE:
            out = out + self.marks[seen]
        out[seen == BLANK] = self.marks[BLANK]  # which has no features
        return out, [n for _, n in marks]

    def transfer(self, emit: np.ndarray) -> np.ndarray:
        """(7, 6) best score from each state before the lines, and from the transcript's beginning, to each state at the last line."""
        best = np.vstack([self.move, self.first]) + emit[0]
        for e in emit[1:]:
            best = (best[:, :, None] + self.move[None]).max(axis=1) + e
        return best

    def viterbi(self, emit: np.ndarray, before: int = -1, last: int = -1) -> list[int]:
        """Best states between a known state before and one at the end (-1: none); of equal ones the smaller."""
        best = (self.move[before] if before >= 0 else self.first) + emit[0]
        back = np.zeros(emit.shape, dtype=np.int8)
        for t in range(1, len(emit)):
            paths = best[:, None] + self.move
            back[t] = paths.argmax(axis=0)
            best = paths.max(axis=0) + emit[t]
        states = [last if last >= 0 else int(best.argmax())]
        for t in range(len(emit) - 1, 0, -1):
            states.append(int(back[t, states[-1]]))
        return states[::-1]


def train_chat(conversations: DataFrame, max_turns: int = MAX_TRAIN_TURNS) -> ChatModel:
    """Counts over at most max_turns turns with a known role, of conversations that are not held out.

    Lines are counted on the executors; the driver gets the counts and the turns' roles.
    """
    known = conversations.where(F.col("conv_id").isNotNull() & F.col("role").isin(*ROLES) & ~held_out(F.col("conv_id")))
    hashed = F.xxhash64("conv_id").alias("h")
    rows = known.select(hashed, F.col("conv_id").cast("string").alias("id"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"), "role", "text").orderBy("h", "id", "turn", "role", F.xxhash64("text")).limit(max_turns)

    def count(batches):
        marks, codes = np.zeros((6, 6)), [np.zeros((n, 6)) for n in _SIZES]
        order = []
        for part in chunks(batches, "text"):
            whole = texts(part.column("text"))
            for h, name, turn, role, text in zip(*[part.column(c).to_pylist() for c in ("h", "id", "turn", "role")], whole):
                r = ROLES.index(role)
                order.append((h, name, turn, r))
                lines = text.split("\n")
                for k, line in enumerate(lines):
                    for table, v in zip(codes, line_codes(line)):
                        table[v, 2 * r + (k > 0)] += 1
                for d in range(-1, len(DIALECTS)):
                    mine = (DIALECTS[d][r] if d >= 0 else "") + text
                    style = (SHARP if ">" in DIALECTS[d][1][-2:] and DIALECTS[d][1][0].isalpha() else TOLD) if d >= 0 else TOLD
                    weight = (1 - MISSING) / len(DIALECTS) if d >= 0 else MISSING
                    mine = mine.split("\n")
                    for k, (m, _) in enumerate(symbols(mine, markers(mine), style)):
                        marks[m, 2 * r + (k > 0)] += weight
        yield pa.RecordBatch.from_pydict({"counts": pa.array([pickle.dumps((marks, codes, order))], pa.binary())})

    marks, codes, order = np.zeros((6, 6)), [np.zeros((n, 6)) for n in _SIZES], []
    for x in rows.mapInArrow(count, "counts binary").collect():
        m, c, o = pickle.loads(bytes(x.counts))
        marks += m
        codes = [a + b for a, b in zip(codes, c)]
        order += o
    turns, opens = np.zeros((3, 3)), np.zeros(3)
    order.sort()
    for a, b in zip([None, *order], order):
        if a is None or a[:2] != b[:2]:
            opens[b[3]] += 1
        else:
            turns[a[3], b[3]] += 1
    return ChatModel(marks, codes, turns, opens)


def _turns(lines: list[str], cuts: list[int], states: list[int]) -> list[tuple[str, str, int]]:
    turns: list[tuple[str, list[str], int]] = []
    for k, (line, n, state) in enumerate(zip(lines, cuts, states)):
        if state % 2 == 0 or not turns:
            turns.append((ROLES[state // 2], [line[n:]], k))
        else:
            turns[-1][1].append(line)
    return [(role, "\n".join(text).strip(), first) for role, text, first in turns]


def parse(transcript: str, model: ChatModel) -> list[tuple[str, str, int]]:
    """Turns: role, text without marker, first line. An empty transcript has no turn."""
    if not transcript.strip():
        return []
    lines = transcript.split("\n")
    found = markers(lines)
    emit, cuts = model.emissions(lines, found, style_of(*seen_markers(found)))
    return _turns(lines, cuts, model.viterbi(emit))


def render(role: str, text: str) -> str:
    """One canonical turn; control marks in the text lose their meaning."""
    return f"<|im_start|>{role}\n" + text.replace("<|im_", "<| im_") + "<|im_end|>"


#: Ways to write a turn of each role, for transcripts made from tables of turns.
DIALECTS = (
    ("System: ", "User: ", "Assistant: "), ("[system] ", "Human: ", "AI: "), ("### System:\n", "### Instruction:\n", "### Response:\n"),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ("**System:** ", "**Q:** ", "**A:** "), ("System: ", "Alice> ", "Robert> "),
)


def write_transcript(turns: list[tuple[str | None, str | None]], dialect: int) -> tuple[str, list[int]]:
    """A transcript in one dialect and the first line of each turn; a null or unknown role gets no marker."""
    lines: list[str] = []
    starts = []
    for role, text in turns:
        starts.append(len(lines))
        mark = DIALECTS[dialect % len(DIALECTS)][ROLES.index(role)] if role in ROLES else ""
        lines += (mark + (text or "")).split("\n")
    return "\n".join(lines), starts


_ROWS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


def _blocks(conversations: DataFrame, model: bytes, block_turns: int, block_chars: int) -> DataFrame:
    """One row a block: conv_id, dialect, part and place (its order), turns, rows, whether its conversation may go on beyond it, and then its markers and matrices."""
    turn = F.coalesce(F.col("turn").cast("bigint"), F.lit(0))
    rows = conversations.select("conv_id", "turn", "role", "text", turn.alias("at"), F.xxhash64("text").alias("h"), F.pmod(F.xxhash64("conv_id"), F.lit(len(DIALECTS))).cast("int").alias("dialect"))
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "conv_id", "at", "role", "h").sortWithinPartitions("conv_id", "at", "role", "h", "text")
    own = conversations.select("conv_id", "turn").schema
    schema = T.StructType([own["conv_id"], T.StructField("turns", T.ArrayType(own["turn"].dataType)), *T._parse_datatype_string("dialect int, part int, place int, open boolean, told boolean, sharp boolean, named boolean, moves binary").fields, T.StructField("rows", _ROWS)])

    def cut(batches):
        """(rows, whether the conversation may go on) of each block."""
        held: list[tuple] = []
        size, goes_on = 0, True  # a partition may begin within a conversation
        for b in batches:
            for row in zip(*[b.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dialect")]):
                if held and held[0][0] != row[0]:
                    yield held, goes_on
                    held, size, goes_on = [], 0, False
                elif held and (len(held) >= block_turns or size >= block_chars):
                    yield held, True
                    held, size, goes_on = [], 0, True
                held.append(row)
                size += len(row[3] or "")
        if held:
            yield held, True

    def run(batches):
        fitted, part = pickle.loads(model), TaskContext.get().partitionId()
        kinds = None
        for place, (held, goes_on) in enumerate(cut(_kept(batches, kinds := []))):
            flags, moves = (None, None, None), None
            if goes_on:
                lines = write_transcript([(r[2], r[3]) for r in held], held[0][4])[0].split("\n")
                found = markers(lines)
                flags = seen_markers(found)
                moves = np.stack([fitted.transfer(fitted.emissions(lines, found, style)[0]) for style in range(4)]).tobytes()
            row = [pa.array([held[0][0]], kinds[0]), pa.array([[r[1] for r in held]], pa.list_(kinds[1])), *[pa.array([v], t) for v, t in zip((held[0][4], part, place), (pa.int32(),) * 3)], pa.array([goes_on]), *[pa.array([f], pa.bool_()) for f in flags], pa.array([moves], pa.binary())]
            rows_ = pa.array([[{"role": r[2], "text": r[3]} for r in held]], pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([*row, rows_], schema.names)

    return ranged.select("conv_id", "turn", "role", "text", "dialect").mapInArrow(run, schema)


def _kept(batches, kinds: list):
    """The batches; kinds gets the Arrow types of conv_id and turn."""
    for b in batches:
        if not kinds:
            kinds += [b.schema.field("conv_id").type, b.schema.field("turn").type]
        yield b


def _ends(blocks: DataFrame) -> DataFrame:
    """(part, place, style, before, last) of blocks whose conversation goes on beyond them: the states at their ends, from their matrices alone."""
    open_ = blocks.where("open").select("conv_id", "part", "place", "told", "sharp", "named", "moves")
    marked = open_.groupBy("conv_id").agg(*[F.bool_or(c).alias(c) for c in ("told", "sharp", "named")])
    rows = open_.drop("told", "sharp", "named").join(marked.withColumnRenamed("conv_id", "__id"), F.col("conv_id").eqNullSafe(F.col("__id")))
    rows = rows.drop("__id").repartition("conv_id").sortWithinPartitions("conv_id", "part", "place")

    def solve(places: list[tuple[int, int]], style: int, backs: list[np.ndarray], best: np.ndarray):
        state = int(best.argmax())
        last = [state]
        for back in backs[:0:-1]:
            state = int(back[state])
            last.append(state)
        last.reverse()
        before = [-1, *last[:-1]]
        return pa.RecordBatch.from_arrays([pa.array([p for p, _ in places], pa.int32()), pa.array([k for _, k in places], pa.int32()), *[pa.array(x, pa.int32()) for x in ([style] * len(places), before, last)]], ["part", "place", "style", "before", "last"])

    def run(batches):
        now, places, backs, best, style = (), [], [], None, 0
        for b in batches:
            for conv, part, place, moves, *flags in zip(*[b.column(c).to_pylist() for c in ("conv_id", "part", "place", "moves", "told", "sharp", "named")]):
                if now != (conv,):
                    if places:
                        yield solve(places, style, backs, best)
                    now, places, backs, best, style = (conv,), [], [], None, style_of(*flags)
                m = np.frombuffer(moves).reshape(4, 7, 6)[style]
                if best is None:
                    best, back = m[6], np.zeros(6, dtype=np.int8)
                else:
                    paths = best[:, None] + m[:6]
                    best, back = paths.max(axis=0), paths.argmax(axis=0).astype(np.int8)
                places.append((part, place))
                backs.append(back)  # six bytes a block
        if places:
            yield solve(places, style, backs, best)

    return rows.mapInArrow(run, "part int, place int, style int, before int, last int")


def recover_roles(conversations: DataFrame, model: ChatModel | None = None, block_turns: int = BLOCK_TURNS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Each conversation's turns written as a transcript in a dialect by its id, parsed back and rendered.

    Rows without a known role get no marker: a transcript that has its own markers, or
    none, is parsed as it is. Returns conv_id, turn, role (recovered), rendered,
    n_chars of the text without marker.
    """
    packed, scratch = pickle.dumps(model or train_chat(conversations)), Scratch(conversations.sparkSession)
    blocks = scratch.write(_blocks(conversations, packed, block_turns, block_chars))
    shape = fields(conversations.select("conv_id", "turn").schema, "role string, rendered string, n_chars bigint")

    def decode(batches):
        fitted = pickle.loads(packed)
        for b in batches:
            kinds = [b.schema.field("conv_id").type, b.schema.field("turns").type.value_type, pa.string(), pa.string(), pa.int64()]
            for k in range(b.num_rows):
                conv, dialect, style, before, last = (b.column(c)[k].as_py() for c in ("conv_id", "dialect", "style", "before", "last"))
                turns, rows = b.column("turns")[k].as_py(), b.column("rows")[k].as_py()
                text, starts = write_transcript([(r["role"], r["text"]) for r in rows], dialect)
                lines = text.split("\n")
                found = markers(lines)
                emit, cuts = fitted.emissions(lines, found, style_of(*seen_markers(found)) if style is None else style)
                said = _turns(lines, cuts, fitted.viterbi(emit, -1 if before is None else before, -1 if last is None else last))
                out, at = [], 0
                for j, (turn, row, start) in enumerate(zip(turns, rows, starts)):
                    end = starts[j + 1] if j + 1 < len(starts) else len(lines)
                    low = at
                    while at < len(said) and said[at][2] < end:
                        at += 1
                    if at > low:
                        out += [(conv, turn, role, render(role, body), len(body)) for role, body, _ in said[low:at]]
                    else:  # the row continues the turn before it
                        body = (row["text"] or "").strip()
                        out.append((conv, turn, said[at - 1][0], render(said[at - 1][0], body), len(body)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], shape.names)

    held = ["conv_id", "turns", "dialect", "rows"]
    nothing = [F.lit(None).cast("int").alias(c) for c in ("style", "before", "last")]
    alone = blocks.where("not open").select(*held, *nothing)
    shared = blocks.where("open").join(_ends(blocks), ["part", "place"]).select(*held, "style", "before", "last")
    return alone.union(shared).mapInArrow(decode, shape)
