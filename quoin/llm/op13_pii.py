"""Operator 13: personal data by fixed patterns and a semi-Markov conditional random field.

Base spans come from four patterns and stay. A chain of digits may hold more than one number, and then its pattern fails as
a whole; addresses may be written around their pattern. Such places are segmented by a semi-Markov random field: a region's
tokens are cut into segments, each a single token outside or a candidate of a type; a candidate is at most LONGEST tokens and
is scored as a whole, by features of its digits, groups, separators, check digit, neighbours and the words before it. The
sum of scores makes a distribution over segmentations; training maximises the likelihood of the right ones by
forward-backward, and the best one is found by dynamic programming over ends and lengths, so boundaries and types are
chosen together. Tokens of base spans stay outside.

Training: windows around base spans of a sample of documents (about SAMPLE_DOCS of them by a hash of id and text, WINDOWS
windows at most) and of fixed examples, each whole and changed: two joined, written in other ways, or spoilt (a wrong check
digit, too many digits) and then to be left out.

Only regions are segmented: digits at most three separators apart, eight or more in number, not all in base spans; and
places with a written-out "at" and "dot". All else counts as outside. Null and empty texts have no spans. Texts of any length
are searched whole, in time linear in the text. Repeated rows get equal results; an empty table gives an empty result; only
doc_id and text are read, so other columns, whatever their names, play no part.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, WINDOWS = 4000, 300
"""Documents looked at for training, in the mean; and windows taken from them, at most."""
LONGEST, GROUPS = 24, 6
"""Tokens of a candidate, and groups of digits in one without letters, at most."""
AROUND = 40
"""Characters of a window before and after its span."""
EPOCHS, STEP, DECAY = 8, 0.5, 1e-4
SURE = 1.0
"""How much more than outside a segment must score to be taken."""

Span = tuple[int, int, int]
"""Kind by number, start, end."""

# base spans

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
CLUSTER = re.compile(r"[+0-9][ ().0-9+-]*")
"""What IPs, cards and phones lie within."""
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    double = digits[-2::-2].translate(_DOUBLED)
    return (sum(map(int, digits[-1::-2])) + sum(map(int, double))) % 10 == 0


_DOUBLED = str.maketrans({str(d): str(2 * d if d < 5 else 2 * d - 9) for d in range(10)})


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, by kind, then start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        # the local part is the whole run before the sign, as far as no match or sign before it has taken it
        start = done + len(text[done:at].rstrip(LOCAL))
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((0, start, m.end()))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    ip, card, phone = [], [], []
    for c in CLUSTER.finditer(text):
        lo, hi = c.span()
        if hi - lo < 7:
            continue
        if text.find(".", lo, hi) >= 0:
            ip += [(1, *m.span()) for m in IP.finditer(text, lo, hi) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m.group().split("."))]
        if hi - lo >= 16:
            card += [(2, *m.span()) for m in CARD.finditer(text, lo, hi) if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        if text.find("+", lo, hi) >= 0:
            phone += [(3, *m.span()) for m in PHONE.finditer(text, lo, hi) if 8 <= len(digits_of(m.group())) <= 15]
    return out + ip + card + phone


# regions, tokens and candidates

SEPARATORS = r"[ \t ().\[\]+/_‐-―-]"
NUMERIC = re.compile(rf"(?:[(+]{{1,2}})?[0-9](?:{SEPARATORS}{{0,3}}[0-9])+")
WRITTEN = re.compile(r"[\[({] ?(?:at|dot) ?[\])}]|\b(?:at|dot)\b", re.I)
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s+|.", re.S)
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+ ?(?P<at>@|[\[({] ?at ?[\])}]|(?<= )at(?= )) ?[A-Za-z0-9-]+(?P<more>(?:(?: ?[\[({] ?dot ?[\])}] ?| dot |\.)[A-Za-z0-9-]+)+)", re.I)
#: Frequent top-level domains.
ENDINGS = frozenset("com org net edu gov info io de fr es uk eu it ch at nl".split())
HINTS = {
    0: re.compile(r"mail|contact|write|schreib|kontakt|écri|contacto", re.I),
    1: re.compile(r"\bip|host|server|addr", re.I),
    2: re.compile(r"card|visa|karte|carte|tarjeta|credit|kredit", re.I),
    3: re.compile(r"tel|phone|call|fax|mobil|ruf|tél|móvil|whatsapp", re.I),
}


def mask_of(text: str, base: list[Span]) -> bytearray:
    """1 for each character of a base span."""
    out = bytearray(len(text))
    for _, a, b in base:
        out[a:b] = b"\1" * (b - a)
    return out


def regions(text: str, mask: bytearray) -> list[tuple[int, int]]:
    """Places that may hold spans beside the masked ones, apart from each other and in order."""
    out = []
    for m in NUMERIC.finditer(text):
        lo, hi = m.span()
        if hi - lo >= 8 and (len(digits_of(m.group())) >= 8 or m.group().count(".") >= 3) and any(not masked and c in "0123456789" for c, masked in zip(m.group(), mask[lo:hi], strict=True)):
            out.append((lo, hi))
    if re.search(r"\bdot\b", text, re.I):
        for m in WRITTEN.finditer(text):
            out.append((max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)))
    out.sort()
    joined: list[tuple[int, int]] = []
    for lo, hi in out:
        if joined and lo <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(hi, joined[-1][1]))
        else:
            joined.append((lo, hi))
    return joined


@dataclass(frozen=True)
class Candidate:
    """Tokens from lo to hi (excluded) as one span of a kind, with its features by number."""

    lo: int
    hi: int
    kind: int
    features: tuple[int, ...]


_names: list[str] = []
_known: dict[str, int] = {}


def _feature(kind: int, name: str) -> int:
    full = f"{KINDS[kind]} {name}"
    if full not in _known:
        _known[full] = len(_names)
        _names.append(full)
    return _known[full]


FEATURES = {
    0: ("bias", "sign", "bracketed at", "bare at", "bracketed dot", "bare dot", "plain dot only", "letters last", "short last", "common last", "hint"),
    1: ("bias", "small parts", "leading zero", "plain dots", "bracketed dots", "number before", "number after", "tight before", "tight after", "hint"),
    2: ("bias", "check digit", "no check digit", "sixteen", "more", "fewer", "one run", "fours", "uneven", "number before", "number after", "tight before", "tight after", "plus before", "hint"),
    3: ("bias", "plus", "double zero", "bracket", "bare", "few digits", "usual digits", "many digits", "one run", "short groups", "long group", "dots", "number before", "number after", "tight before", "tight after", "hint"),
}
#: The features' numbers do not depend on what is met first.
for _kind, _all in FEATURES.items():
    for _name in _all:
        _feature(_kind, _name)


def _email(s: str) -> list[str] | None:
    m = EMAIL.fullmatch(s)
    if not m:
        return None
    at, more = m["at"].lower(), m["more"].lower()
    last = re.split(r"[^a-z0-9-]+", more)[-1]
    bare_dot, boxed = " dot " in more and not re.search(r"[\[({] ?dot", more), bool(re.search(r"[\[({] ?dot", more))
    if at == "at" and not (bare_dot or boxed):  # "at" is a word of its own: without a written dot this is prose
        return None
    out = ["sign" if at == "@" else "bare at" if at == "at" else "bracketed at"]
    out += ["bracketed dot"] * boxed + ["bare dot"] * bare_dot + ["plain dot only"] * (not boxed and not bare_dot)
    return out + ["letters last"] * last.isalpha() + ["short last"] * (2 <= len(last) <= 6) + ["common last"] * (last in ENDINGS)


def _ip(s: str) -> list[str] | None:
    parts = re.split(r"\[\.\]|\(\.\)|\.", s)
    if len(parts) != 4 or not all(p.isascii() and p.isdigit() for p in parts):
        return None
    out = ["small parts"] * all(len(p) < 5 and int(p) <= 255 for p in parts) + ["leading zero"] * any(len(p) > 1 and p[0] == "0" for p in parts)
    return out + (["bracketed dots"] if re.search(r"[\[(]", s) else ["plain dots"])


def _card(s: str, groups: list[str]) -> list[str] | None:
    n = sum(map(len, groups))
    if not 12 <= n <= 19 or not s[0].isdigit() or not s[-1].isdigit() or len(re.sub(r"[0-9]", "", s)) != len(groups) - 1:
        return None
    out = ["check digit" if luhn("".join(groups)) else "no check digit", "sixteen" if n == 16 else "more" if n > 16 else "fewer"]
    return out + (["one run"] if len(groups) == 1 else ["fours"] if all(len(g) == 4 for g in groups[:-1]) and len(set(re.sub(r"[0-9]", "", s))) == 1 else ["uneven"])


def _phone(s: str, groups: list[str]) -> list[str] | None:
    n = sum(map(len, groups))
    if not 7 <= n <= 15 or s[0] not in "+(0123456789" or not s[-1].isdigit() or "+" in s[1:] and not s.startswith("(+"):
        return None
    out = ["plus" if s.startswith(("+", "(+")) else "double zero" if s.startswith("00") else "bracket" if s[0] == "(" else "bare"]
    out += ["few digits" if n < 8 else "usual digits" if n < 13 else "many digits"]
    out += ["one run"] if len(groups) == 1 else ["long group" if max(map(len, groups)) > 5 else "short groups"]
    return out + ["dots"] * ("." in s)


class Region:
    """A region's tokens and its candidates."""

    def __init__(self, text: str, lo: int, hi: int, mask: bytearray):
        self.at = [m.span() for m in TOKEN.finditer(text, lo, hi)]
        tokens = [text[a:b] for a, b in self.at]
        taken = [1 in mask[a:b] for a, b in self.at]
        count = np.concatenate([[0], np.cumsum([len(t) if t[0] in "0123456789" else 0 for t in tokens])]).tolist()
        written = [bool(re.fullmatch("at|dot|@", t, re.I)) for t in tokens]
        runs = np.concatenate([[0], np.cumsum([t[0] in "0123456789" for t in tokens])]).tolist()
        signs = np.concatenate([[0], np.cumsum(written)]).tolist()
        blocked = np.concatenate([[0], np.cumsum(taken)]).tolist()
        words = np.concatenate([[0], np.cumsum([t[0].isalpha() for t in tokens])]).tolist()
        self.candidates: list[list[Candidate]] = [[] for _ in range(len(tokens) + 1)]  # by end
        self.n = len(tokens)
        for i, t in enumerate(tokens):
            if taken[i] or not (t[0].isalnum() or t[0] in "+("):
                continue
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                if blocked[j] > blocked[i]:
                    break
                if not tokens[j - 1][0].isalnum():
                    continue
                number, any_words = count[j] - count[i], words[j] > words[i]
                if signs[-1] == 0 and (any_words or number > 19 or runs[j] - runs[i] > GROUPS):
                    break
                if signs[j] == signs[i] if any_words else not 4 <= number <= 19 or runs[j] - runs[i] > GROUPS:
                    continue
                s = text[self.at[i][0] : self.at[j - 1][1]]
                if any_words:
                    self._add(i, j, 0, _email(s), text, tokens)
                    continue
                groups = re.findall("[0-9]+", s)
                self._add(i, j, 1, _ip(s), text, tokens)
                self._add(i, j, 2, _card(s, groups), text, tokens)
                self._add(i, j, 3, _phone(s, groups), text, tokens)

    def _add(self, i: int, j: int, kind: int, names: list[str] | None, text: str, tokens: list[str]) -> None:
        if names is None:
            return
        if kind:
            for side, at, step in (("before", i - 1, -1), ("after", j, 1)):  # a number there, behind a blank or closer
                if 0 <= at < self.n and (tokens[at][0] in "0123456789" or 0 <= at + step < self.n and tokens[at + step][0] in "0123456789"):
                    names.append(f"{'number' if tokens[at].isspace() else 'tight'} {side}")
        if kind == 2 and i and tokens[i - 1] == "+":
            names.append("plus before")
        if HINTS[kind].search(text, max(0, self.at[i][0] - 24), self.at[i][0]):
            names.append("hint")
        self.candidates[j].append(Candidate(i, j, kind, tuple(_known[f"{KINDS[kind]} {n}"] for n in ("bias", *names))))

    def best(self, weights: np.ndarray, sure: float = 0.0) -> list[Candidate]:
        """The segmentation of the highest score; a token outside scores 0, a candidate its weights less `sure`."""
        top, last = [0.0] * (self.n + 1), [None] * (self.n + 1)
        for j in range(1, self.n + 1):
            top[j] = top[j - 1]
            for c in self.candidates[j]:
                s = top[c.lo] + sum(weights[f] for f in c.features) - sure
                if s > top[j]:
                    top[j], last[j] = s, c
        out, j = [], self.n
        while j:
            c = last[j]
            out += [c] if c else []
            j = c.lo if c else j - 1
        return out[::-1]

    def expected(self, weights: np.ndarray) -> list[tuple[Candidate, float]]:
        """Each candidate with its probability, by forward and backward sums over all segmentations."""
        flat = [c for cs in self.candidates for c in cs]
        score = {id(c): float(sum(weights[f] for f in c.features)) for c in flat}
        forward, backward = [0.0] * (self.n + 1), [0.0] * (self.n + 1)
        starts: list[list[Candidate]] = [[] for _ in range(self.n + 1)]
        for c in flat:
            starts[c.lo].append(c)
        for j in range(1, self.n + 1):
            forward[j] = _log_sum([forward[j - 1], *(forward[c.lo] + score[id(c)] for c in self.candidates[j])])
        for i in range(self.n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1], *(backward[c.hi] + score[id(c)] for c in starts[i])])
        return [(c, float(np.exp(forward[c.lo] + score[id(c)] + backward[c.hi] - forward[-1]))) for c in flat]


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top if len(x) == 1 else top + float(np.log(sum(np.exp(v - top) for v in x)))


def added(text: str, base: list[Span], weights: np.ndarray) -> list[Span]:
    """The spans that the field finds beside the base ones."""
    out, mask = [], mask_of(text, base)
    for lo, hi in regions(text, mask):
        r = Region(text, lo, hi, mask)
        out += [(c.kind, r.at[c.lo][0], r.at[c.hi - 1][1]) for c in r.best(weights, SURE)]
    return out


# training

#: Fixed examples, so that every kind is met whatever the documents hold.
EXAMPLES = (
    ("write to anna.berg@mail.example.org today", 0), ("host 10.20.30.40 is down", 1), ("card 4111111111111111 was used", 2), ("pay by 5500 0000 0000 0004 now", 2),
    ("call +1 (212) 555-0123 at noon", 3), ("tel +49 30 1234567 bitte", 3), ("mail jo@example.com or not", 0), ("from 203.0.113.77 came", 1),
)
#: Fixed texts without personal data.
CLEAN = ("on 2024-05-06 12:30 at 7.5 percent", "version 10.4.12.7.3 of 2023", "order 123456789012 and 98765432", "isbn 978-3-16-148410-0 page 12", "3.14159265358979 and 2.718281828", "look at the dot on page 12", "aim at a dot or two", "stay at home dot dot dot", "points at red dot in the", "meet at noon, dot your signs", "sum 1 234 567 890 of 12 345 678", "0000 0000 0000 0000 0000 0000")


def examples(windows: list[tuple[str, int, int, int]], seed: int = 7) -> list[tuple[str, list[Span]]]:
    """(text, right spans) from windows (text, kind, start, end)."""
    rng, out = random.Random(seed), []
    spoil = lambda d: str((int(d) + rng.randrange(1, 10)) % 10)
    whole = [(t, k, a, b) for t, k, a, b in windows]
    for t, k, a, b in whole:
        s, head, tail = t[a:b], t[:a], t[b:]
        put = lambda new, right=True: out.append((head + new + tail, [(k, a, a + len(new))] if right else []))  # noqa: B023, E731
        put(s)
        # two numbers in one chain
        other = rng.choice(whole)
        for gap in (" ", "-" if k == 2 else " ", ", "):
            o = other[0][other[2] : other[3]]
            if k and other[1]:
                out.append((head + s + gap + o + tail, [(k, a, a + len(s)), (other[1], a + len(s) + len(gap), a + len(s) + len(gap) + len(o))]))
        if k == 0:
            name, _, host = s.partition("@")
            for at, dot in (("[at]", "[dot]"), (" (at) ", "."), (" at ", " dot "), ("@", "[dot]"), ("(at)", "(dot)")):
                put(name + at + host.replace(".", dot))
            put(name + " at " + host.replace(".", " "), False)
        elif k == 1:
            put(s.replace(".", "[.]"))
            put(s.replace(".", "(.)"))
            put(f"{rng.randrange(256, 999)}{s[s.index('.') :]}", False)
            put(f"{s}.{rng.randrange(99)}", False)
        elif k == 2:
            d = digits_of(s)
            put(" ".join(d[i : i + 4] for i in range(0, len(d), 4)))
            put(".".join(d[i : i + 4] for i in range(0, len(d), 4)))
            put(d[:-1] + spoil(d[-1]), False)
            put(" ".join((d[:-1] + spoil(d[-1]))[i : i + 4] for i in range(0, len(d), 4)), False)
            put(d + d[:3], False)
        else:
            put("00" + s[1:])
            put(s[1:] if s[1:2] != "0" else s, s[1:2] == "0")
            put(digits_of(s), False)
            put(digits_of(s)[:12] + str(rng.randrange(10**4)), False)
    return out + [(t, []) for t in CLEAN]


def windows_of(text: str, most: int = 8) -> list[tuple[str, int, int, int]]:
    out = []
    for k, a, b in base_spans(text)[:most]:
        lo = max(0, a - AROUND)
        if b - a <= 4 * AROUND:
            out.append((text[lo : b + AROUND], k, a - lo, b - lo))
    return out


def train(windows: list[tuple[str, int, int, int]]) -> np.ndarray:
    """Weights by gradient steps (scaled by what each has moved so far) on the likelihood of the right segmentations."""
    fixed = [w for t, k in EXAMPLES for w in windows_of(t) if w[1] == k]
    data = []
    for text, right in examples(fixed + windows):
        want, mask = set(right), bytearray(len(text))
        spans = regions(text, mask) + [(a, b) for _, a, b in right]
        merged: list[list[int]] = []
        for lo, hi in sorted(spans):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        for lo, hi in merged:
            r = Region(text, lo, hi, mask)
            gold = {id(c) for cs in r.candidates for c in cs if (c.kind, r.at[c.lo][0], r.at[c.hi - 1][1]) in want}
            if any(r.candidates):
                data.append((r, gold))
    weights, moved = np.zeros(len(_names)), np.full(len(_names), 1e-6)
    rng = random.Random(11)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for r, gold in data:
            g = np.zeros(len(weights))
            for c, p in r.expected(weights):
                g[list(c.features)] += (id(c) in gold) - p
            g -= DECAY * weights
            moved += g * g
            weights += STEP * g / np.sqrt(moved)
    return weights


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, most: int = WINDOWS) -> np.ndarray:
    """Weights learnt from docs (doc_id, text)."""
    every = max(1, docs.count() // sample_docs)
    some = docs.where(F.col("text").isNotNull() & (F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [w for t in b.column(0).to_pylist() for w in windows_of(t)]
            t, k, lo, hi = zip(*got, strict=True) if got else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), *(pa.array(x, pa.int32()) for x in (k, lo, hi))], ["t", "k", "lo", "hi"])

    found = some.select("text").mapInArrow(run, "t string, k int, lo int, hi int").distinct()
    rows = found.orderBy(F.xxhash64("t", "k", "lo"), "t", "k", "lo", "hi").limit(most).collect()  # short windows, `most` of them
    return train([tuple(r) for r in rows])


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, base and added spans (kind, start, end) for each row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(weights)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = held.value
        tell = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for b in batches:
            base, more = [], []
            for t in b.column(1).to_pylist():
                one = base_spans(t) if t else []
                base.append(tell(one))
                more.append(tell(added(t, one, w)) if t else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "added"])

    spans = "array<struct<kind: string, start: int, end: int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, base {spans}, added {spans}")


def digest(found: DataFrame) -> DataFrame:
    """The counts and digest of the base spans, and all spans as text."""
    place = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    every = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(place[s["kind"]].alias("place"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    count = {k: F.size("base") - F.size(F.array_remove("base.kind", k)) for k in KINDS}
    return found.select("doc_id", *[n.cast("long").alias(f"n_{k}") for k, n in count.items()], F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(every).alias("spans"), F.size("added").cast("long").alias("n_added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document; n_email to n_phone count the base spans, n_added the others."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digest(find(docs, fit(docs)))
