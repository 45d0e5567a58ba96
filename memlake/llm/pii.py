"""Personal data: fixed patterns and a linear-chain CRF over word shapes.

The patterns give the base spans of email, ip, card and phone. The CRF, trained
on a small labelled table made by rule below, labels whitespace-separated words by
Viterbi in numpy batches and adds spans, also of kind ``secret``, that overlap no
span found before. Only words near a digit, an at sign or a long word of mixed case are
decoded: nearly all other words have shapes that the table labels as outside alone,
so each run of words within REACH of such a word is a chain of its own. A secret of
small letters alone, or of capitals alone, is not found.

Offsets are code points, ends exclusive. Null text counts as empty. Repeated rows
give repeated results, extra columns are ignored, an empty table an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import pickle
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memlake.llm.common import WHITE, chunks, fields, flat, keep, reduce_rows, word_bounds
from memlake.llm.crf import Batch, Crf

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
REACH = 3
#: Letters of a word of mixed case that may be a secret.
LONG_WORD = 20
TABLE_ROWS = 1500

_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_RUN = re.compile(rb"[A-Za-z0-9._%+-]*")
# a match never begins inside a run of digits, as one from the run's start would come first
_IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(rb"[0-9]+")


def luhn(digits: bytes) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = (c - 48) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(kind, start, end) in bytes: leftmost, non-overlapping for each kind, failing matches dropped."""
    out, free, at = [], 0, raw.find(b"@")
    while at >= 0:  # an email's local part is the whole run before the at sign
        low = at
        while low > free and raw[low - 1] in _LOCAL:
            low -= 1
        if low < at and (m := _DOMAIN.match(raw, at + 1)):
            out.append((0, low, m.end()))
            free = m.end()
        at = raw.find(b"@", max(at + 1, free))
    for m in _IP.finditer(raw):
        if all(len(x.lstrip(b"0")) <= 3 and int(x) <= 255 for x in m[0].split(b".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(raw):
        d = b"".join(_DIGITS.findall(m[0]))
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(raw):
        if 10 <= sum(map(len, _DIGITS.findall(m[0]))) <= 15:
            out.append((3, *m.span()))
    return sorted(out, key=lambda x: (x[1], x[0]))


# --- word shapes -----------------------------------------------------------

_CUES = {w: k + 1 for k, w in enumerate((b"token", b"key", b"apikey", b"password", b"passwd", b"secret", b"phone", b"tel", b"call", b"mobile", b"fax", b"card", b"visa", b"ip", b"host", b"email", b"mail", b"contact", b"version", b"page", b"chapter", b"isbn", b"order", b"id"))}
_SHAPE = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.S)
_EDGE = b"\"'`,;:!?<>[]{}|*#$%&.="
_SHAPES = 2048
_WIDTHS = [_SHAPES, 40, 24, 32, len(_CUES) + 1] + [64, len(_CUES) + 1, 64, 64, 64]
_SHIFTS = np.cumsum([0, *_WIDTHS[:-1]])
N_FEATURES = int(sum(_WIDTHS))


def _stable(x: bytes) -> int:
    return int.from_bytes(hashlib.blake2s(x, digest_size=4).digest(), "little")


def word_shape(word: bytes) -> tuple[int, int, int, int, int, int]:
    """Five features of a word alone and a coarse class for its neighbours."""
    core = word.strip(_EDGE)
    shape = _RUNS.sub(rb"\1", core.translate(_SHAPE))[:16]
    digits = b"".join(_DIGITS.findall(core))
    n, letters = len(digits), sum(map(str.isalpha, core.decode(errors="ignore")))
    sized = next(k for k, top in enumerate((0, 1, 2, 3, 4, 6, 9, 13, 19, 10**9)) if n <= top)
    mixed = (0 if not letters else 1 if letters <= n else 2) + 3 * (core[:1] == b"+") if n else 0
    count = min(sized * 4 + mixed % 4, 39)
    parts = core.split(b".")
    dotted = len(parts) == 4 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    at = core.count(b"@")
    host = at == 1 and b"." in core.split(b"@")[1].strip(b".") and bool(core.split(b"@")[0])
    marks = (1 if dotted else 0) + 2 * min(at, 1) + 4 * host + 8 * (14 <= n <= 19 and not letters and luhn(digits))
    length = min(len(core), 47) // 4 + 12 * (len(core) >= 20 and bool(n) and bool(letters))
    cue = _CUES.get(core.lower(), 0)
    coarse = min(sized, 7) * 8 + min(marks and 7, 7) if n or at else (1 if core[:1].isupper() else 2 if core else 3 + min(len(word), 3))
    return _stable(shape) % _SHAPES, count, min(marks, 23), min(length, 31), cue, min(coarse, 63)


def chain_features(shapes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Feature indexes of each word: its own, and class and cue of its neighbours in the chain."""
    n = len(shapes)
    starts = np.cumsum(lengths) - lengths
    first, last = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    first[starts], last[starts + lengths - 1] = True, True
    coarse, cue = shapes[:, 5], shapes[:, 4]
    prev, nxt, prev_cue = np.full(n, 63), np.full(n, 63), np.zeros(n, dtype=np.int64)
    prev[1:][~first[1:]], nxt[:-1][~last[:-1]] = coarse[:-1][~first[1:]], coarse[1:][~last[:-1]]
    prev_cue[1:][~first[1:]] = cue[:-1][~first[1:]]
    second_cue = np.zeros(n, dtype=np.int64)
    second_cue[1:][~first[1:]] = prev_cue[:-1][~first[1:]]
    both = (prev // 8) * 8 + nxt // 8
    cols = [shapes[:, k] for k in range(5)] + [prev, np.maximum(prev_cue, second_cue), nxt, both, (coarse // 8) * 8 + nxt // 8]
    return np.stack([np.asarray(c) + s for c, s in zip(cols, _SHIFTS)], axis=1)


# --- the labelled table ----------------------------------------------------


def labelled_table(rows: int = TABLE_ROWS, seed: int = 7) -> list[list[tuple[str, str]]]:
    """Sentences of (word, kind or '') pairs; a kind's words follow each other as one span."""
    r = random.Random(seed)
    syllables = "an er on the re in ti ha es en de la que ou ment der ung sch ein ado ción ra".split()
    junk = ("", "", "", "", ",", ".", "$$$", "###", "!!", "%%%", "***", "&&&")

    def word() -> str:
        w = "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
        return (w.capitalize() if r.random() < 0.2 else w) + r.choice(junk)

    def digits(n: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(n))

    def card() -> str:
        while True:
            d = digits(r.choice((14, 15, 16, 16, 16, 16, 19)))
            if luhn(d.encode()):
                return d

    def bad_card() -> str:
        while True:
            d = digits(r.choice((14, 15, 16, 16, 17, 18, 19)))
            if not luhn(d.encode()):
                return d

    def host() -> str:
        return ".".join("".join(r.choice(syllables) for _ in range(2)).replace("ó", "o") for _ in range(r.randint(1, 2))) + r.choice((".com", ".org", ".net", ".example.com", ".de", ".fr", ".io"))

    def secret() -> str:
        alphabet = r.choice(("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        return "".join(r.choice(alphabet) for _ in range(r.choice((24, 32, 32, 40, 40, 64))))

    def entity() -> tuple[str, list[str], list[str]]:
        """Kind, words before the span, words of the span."""
        kind = r.choice(("email", "ip", "card", "card", "phone", "phone", "secret", "", "", "", "", ""))
        name = "".join(r.choice(syllables) for _ in range(2)).replace("ó", "o")
        if kind == "email":
            return kind, r.choice(([], ["mail"], ["contact"])), r.choice(([f"{name}{digits(r.randint(0, 4))}@{host()}"], [f"{name}.{name}@{host()}"], [f"<{name}@{host()}>"], [name, "@", host()]))
        if kind == "ip":
            a = ".".join(str(r.randint(0, 255)) for _ in range(4))
            return kind, r.choice(([], ["host"], ["ip"])), r.choice(([a], [a], [f"{a}:{r.randint(80, 9000)}"], [f"[{a}]"]))
        if kind == "card":
            d = card()
            groups = [d[k : k + 4] for k in range(0, len(d), 4)]
            return kind, r.choice(([], ["card"], ["visa"])), r.choice(([d], [d], groups, ["-".join(groups)]))
        if kind == "phone":
            a, b, c = digits(3), digits(3), digits(4)
            return kind, r.choice(([], ["call"], ["tel"], ["phone"])), r.choice(([f"+{r.randint(1, 99)}", f"({a})", f"{b}-{c}"], [f"({a})", f"{b}-{c}"], [f"+{r.randint(1, 99)}", a, b, c], [f"+{r.randint(1, 99)}-{a}-{b}-{c}"], [f"{a}-{b}-{c}"]))
        if kind == "secret":
            cue = r.choice(("token", "key", "secret", "password", "apikey"))
            return kind, r.choice(([cue, "="], [cue], [cue + ":"])), r.choice(([f'"{secret()}"'], [secret()]))
        plain = r.choice(
            ([str(r.randint(1000, 2100))], [f"{r.randint(1, 99)}.{digits(2)}"], [f"v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}"], ["version", f"{r.randint(1, 9)}.{r.randint(0, 20)}"], ["chapter", str(r.randint(1, 40))], ["page", str(r.randint(1, 900))],
             [f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}"], [f"{r.randint(1990, 2030)}-{digits(2)}-{digits(2)}"], [f"{r.randint(0, 23)}:{digits(2)}"], [f"${r.randint(1, 9999)}"], [f"{r.randint(1, 100)}%"], [f"{name}{r.randint(1, 99)}"], ["id", digits(r.randint(5, 9))],
             [bad_card()], ["order", bad_card()], [f"{r.randint(1, 99)}th"], [f"({r.randint(1, 99)})"], [f"[{r.randint(1, 99)}]"], ["isbn", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"], [digits(r.randint(1, 6)), digits(r.randint(1, 3)), digits(r.randint(1, 4))], [f"@{name}"], [f"https://{host()}/{name}/{digits(2)}"], ["Version", "2.0,"],
             ["".join("".join(r.choice(syllables) for _ in range(r.randint(2, 4))).capitalize() for _ in range(r.randint(3, 6)))])
        )
        return "", [], plain

    table = []
    for _ in range(rows):
        row = [(word(), "") for _ in range(r.randint(1, 5))]
        for _ in range(r.randint(1, 3)):
            kind, before, span = entity()
            row += [(w, "") for w in before]
            tail = r.choice(junk)
            row += [(w + (tail if k == len(span) - 1 else ""), (("B-" if not k else "I-") + kind) if kind else "") for k, w in enumerate(span)]
            row += [(word(), "") for _ in range(r.randint(1, 4))]
        table.append(row)
    return table


STATES = ["", *[f"{p}-{k}" for k in KINDS for p in "BI"]]


def train_pii(table: list[list[tuple[str, str]]] | None = None) -> Crf:
    rows = table if table is not None else labelled_table()
    lengths = np.array([len(x) for x in rows])
    shapes = np.array([word_shape(w.encode()) for row in rows for w, _ in row], dtype=np.int64)
    states = np.array([STATES.index(s) for row in rows for _, s in row])
    crf = Crf(N_FEATURES, len(STATES)).fit(chain_features(shapes, lengths), states, lengths, rounds=70)
    for a, name in enumerate(STATES):  # an inner label follows its own kind alone
        if name[:2] == "I-":
            crf.first[a] = -1e6
            for b, before in enumerate(STATES):
                if before[2:] != name[2:]:
                    crf.moves[b, a] = -1e6
    return crf


def crf_spans(crf: Crf, data: np.ndarray, bounds: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) in bytes of each row's decoded spans, edge punctuation cut off."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    marked = ((data >= 48) & (data <= 57)) | (data == 64)
    starts, ends, first = word_bounds(data, bounds, WHITE)
    total = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(marked, out=total[1:])
    capital = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data >= 65) & (data <= 90), out=capital[1:])
    capitals = capital[ends] - capital[starts]
    mixed = (ends - starts >= LONG_WORD) & (capitals >= 4) & (capitals <= ends - starts - 4)
    seeds = np.flatnonzero((total[ends] > total[starts]) | mixed)
    if not len(seeds):
        return out
    row = np.searchsorted(first, seeds, side="right") - 1
    low, high = np.maximum(seeds - REACH, first[row]), np.minimum(seeds + REACH + 1, first[row + 1])
    fresh = np.ones(len(seeds), dtype=bool)
    fresh[1:] = (low[1:] > high[:-1]) | (row[1:] != row[:-1])
    begin = low[fresh]
    end = np.append(high[:-1][fresh[1:]], high[-1])
    lengths = end - begin
    words = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)])
    raw = data.tobytes()
    known: dict[bytes, tuple] = keep("shapes", dict)
    if len(known) > 50_000:
        known.clear()
    shapes = np.empty((len(words), 6), dtype=np.int64)
    for k, (a, b) in enumerate(zip(starts[words].tolist(), ends[words].tolist())):
        w = raw[a:b]
        shape = known.get(w)
        if shape is None:
            shape = word_shape(w)
            if b - a <= 64:
                known[w] = shape
        shapes[k] = shape
    path = crf.viterbi(crf.emissions(chain_features(shapes, lengths)), Batch(lengths))
    owner = np.repeat(row[fresh], lengths)
    begins = np.cumsum(lengths) - lengths
    chain = np.repeat(np.arange(len(lengths)), lengths)
    for k in np.flatnonzero(path):
        name = STATES[path[k]]
        if name[0] != "B":
            continue
        stop = k + 1
        while stop < len(path) and chain[stop] == chain[k] and STATES[path[stop]] == "I-" + name[2:]:
            stop += 1
        a, b = int(starts[words[k]]), int(ends[words[stop - 1]])
        body = raw[a:b]
        a += len(body) - len(body.lstrip(_EDGE))
        b -= len(body) - len(body.rstrip(_EDGE))
        if a < b:
            base = int(bounds[owner[k]])
            out[owner[k]].append((KINDS.index(name[2:]), a - base, b - base))
    del begins
    return out


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (kind, start, end) that overlap none of base, by one search each."""
    if not base:
        return spans
    order = sorted(b[1:] for b in base)
    starts, reach = [a for a, _ in order], list(itertools.accumulate((b for _, b in order), max))
    return [x for x in spans if not (k := bisect.bisect_left(starts, x[2])) or reach[k - 1] <= x[1]]


def detect(crf: Crf, data: np.ndarray, bounds: np.ndarray) -> list[tuple[list, list]]:
    """For each row the base spans and all spans, as (kind, start, end) in code points."""
    marked = ((data >= 48) & (data <= 57)) | (data == 64)
    some = reduce_rows(np.maximum, marked.astype(np.int8), bounds) > 0
    added = crf_spans(crf, data, bounds)
    out = []
    for k in range(len(bounds) - 1):
        if not some[k] and not added[k]:
            out.append(([], []))
            continue
        part = data[bounds[k] : bounds[k + 1]]
        base = base_spans(part.tobytes())
        extra = apart(added[k], base)
        if base or extra:
            points = np.zeros(len(part) + 1, dtype=np.int64)
            np.cumsum((part & 0xC0) != 0x80, out=points[1:])
            base = [(x[0], int(points[x[1]]), int(points[x[2]])) for x in base]
            extra = [(x[0], int(points[x[1]]), int(points[x[2]])) for x in extra]
        out.append((base, sorted(base + extra, key=lambda x: (x[1], x[0]))))
    return out


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """For each document: doc_id, a count of each base kind, the base spans' digest, n_added, all spans."""
    packed = pickle.dumps(crf or train_pii())

    def run(batches):
        model = pickle.loads(packed)
        for part in chunks(batches, "text"):
            found = detect(model, *flat(part.column("text")))
            cols = [part.column("doc_id")] + [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            cols += [pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found]), pa.array([_joined(every) for _, every in found]), pa.array([len(every) - len(base) for base, every in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select("doc_id", "text").mapInArrow(run, fields(docs.select("doc_id").schema, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each span, or run of overlapping spans, becomes its first kind in brackets."""
    out, at = [], 0
    for k, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask_pii(docs: DataFrame, crf: Crf | None = None) -> DataFrame:
    """docs with personal data in text masked and, where there is one, n_chars counted again. Null text stays null."""
    packed = pickle.dumps(crf or train_pii())
    names = docs.columns
    counted = "n_chars" in names

    def run(batches):
        model = pickle.loads(packed)
        for part in chunks(batches, "text"):
            found = detect(model, *flat(part.column("text")))
            new = [t if t is None or not every else redact(t, every) for t, (_, every) in zip(part.column("text").to_pylist(), found)]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(new, pa.string())], ["row", "text"])

    rest = [c for c in names if c != "text" and not (c == "n_chars" and counted)]
    source = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    got = source.mapInArrow(run, fields(source.select("row").schema, "text string"))
    pick = {"text": F.col("text")} | {c: F.col("row").getField(c) for c in rest}
    if counted:
        pick["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return got.select(*[pick[c].alias(c) for c in names])
