"""Personal data by weak supervision.

Patterns find candidates: four strict kinds, which always count, and looser ones. Labelers vote on each candidate: its
checks, its kind's gazetteer (ends of host names, networks, calling and area codes, countries and lengths of IBANs, shapes
and prefixes of secrets; none for cards and national ids), the words before it, and what touches it. Expectation-maximisation over the counts of vote
patterns, of all candidates, estimates how reliable each labeler is and how likely each pattern; a logistic model of the
candidate's features is trained on these and decides on the looser candidates. What reaches the driver are counts of
patterns of votes and features, whose number is bounded whatever the corpus.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches, lean, read

KINDS = ("email", "ip", "card", "phone", "iban", "national_id", "secret")
STRICT = 4
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match never starts within a run of digits: if it could, one would start before it.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOOSE = (
    ("phone", re.compile(r"(?<![\w+])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?!\w)")),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?!\w)")),
    ("national_id", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])")),
    # A run with a digit and a letter anywhere in it; shorter ones only as the value of a word for secrets.
    ("secret", re.compile(r"(?<![\w+/-])(?=[\w+/-]{20})(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])[A-Za-z0-9_+/-]{20,}+(?:={1,2}(?![\w+/=-]))?(?![\w+/-])")),
    ("secret", re.compile(r"(?i:token|secret|passw(?:or)?d|key|bearer|credential)s?[\"'\]]{0,2}\x20{0,4}(?:[:=]{1,2}>?|(?<=[Bb]earer\x20))\x20{0,4}[\"']?(?=[A-Za-z_+/-]*[0-9])(?=[0-9_+/-]*[A-Za-z])([A-Za-z0-9_+/-]{8,19}+(?:={1,2}(?![\w+/=-]))?)(?![\w+/-])")),
)
# Words that go before personal data or before other numbers, and common ends of host names.
BEFORE = {
    "email": "mail email contact write address",
    "ip": "ip host server address client login",
    "card": "card visa credit debit payment account",
    "phone": "phone tel call mobile fax cell telephone",
    "iban": "iban account bank transfer",
    "national_id": "ssn social security id insurance",
    "secret": "token secret password passwd key apikey bearer credential",
}
#: Countries of IBANs with their lengths, and calling codes of one or two digits or the first two of three.
IBANS = dict(x.split(":") for x in "AD:24 AE:23 AL:28 AT:20 AZ:28 BA:20 BE:16 BG:22 BH:22 BR:29 BY:28 CH:21 CR:22 CY:28 CZ:24 DE:22 DK:18 DO:28 EE:20 EG:29 ES:24 FI:18 FO:18 FR:27 GB:22 GE:22 GI:23 GL:18 GR:27 GT:28 HR:21 HU:28 IE:22 IL:23 IQ:23 IS:26 IT:27 JO:30 KW:30 KZ:20 LB:28 LC:32 LI:21 LT:20 LU:20 LV:21 LY:25 MC:27 MD:24 ME:22 MK:19 MR:27 MT:31 MU:30 NL:18 NO:15 PK:24 PL:28 PS:29 PT:25 QA:29 RO:24 RS:22 SA:24 SC:31 SE:24 SI:19 SK:24 SM:27 ST:25 SV:28 TL:23 TN:24 TR:26 UA:29 VA:22 VG:24 XK:20".split())
CALLING = tuple("1 7 20 21 22 23 24 25 26 27 29 30 31 32 33 34 35 36 37 38 39 40 41 42 43 44 45 46 47 48 49 50 51 52 53 54 55 56 57 58 59 60 61 62 63 64 65 66 67 68 69 80 81 82 84 85 86 87 88 90 91 92 93 94 95 96 97 98 99".split())
PREFIXES = tuple("AKIA ASIA AIza ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- sk_live_ sk_test_ rk_live_ rk_test_ pk_live_ pk_test_ sk- xoxb- xoxp- xoxa- xoxr- eyJ npm_ pypi- hf_ dop_v1_".split())
#: Parts written like words, capitals or short numbers, with marks between them: names, paths, slugs.
PART = r"(?:[A-Z]?[a-z]{2,}+(?:[0-9]{0,4}+[A-Z][a-z]++)*+[0-9]{0,4}+|[A-Z]++[0-9]{0,4}+|[a-z][0-9]{0,4}+|[0-9]{1,8}+)"
SPELLED = re.compile(rf"[_+/-]*+(?:{PART}[_+/-]++)*+{PART}?")
NUMBERS = "version section figure isbn page chapter release doi commit sha hash checksum md5 serial model part"
ENDINGS = "com org net edu gov io co info biz de fr es it uk nl eu ch at be pl ru cn jp in br us ca au"
WORD = re.compile(r"[A-Za-z]+")
NEAR = 40
LABELERS = 4
STEPS = 50


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def checked(kind: str, s: str) -> int:
    """1 or -1 where the kind has a checksum or a limit, else 0."""
    if kind == "card":
        d = re.sub("[ -]", "", s)
        return 1 if 14 <= len(d) <= 19 and luhn(d) else -1
    if kind == "ip":
        return 1 if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split(".")) else -1
    if kind == "iban":
        x = s.replace(" ", "")
        return 1 if int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97 == 1 else -1
    if kind == "national_id":
        return -1 if s[:3] in ("000", "666") or s[0] == "9" or s[4:6] == "00" or s[7:] == "0000" else 1
    return 0


def dialled(s: str) -> int:
    """1 for a calling code that exists, or without one for an area and an exchange of the North American plan, else -1."""
    d = re.sub("[^0-9]", "", s)
    if s.startswith("+"):
        return 1 if d.startswith(CALLING) else -1
    return 1 if d[0] not in "01" and d[1:3] != "11" and d[3] not in "01" and d[4:6] != "11" else -1


def looks_secret(s: str) -> int:
    """1 for a known prefix, long hexadecimals or many different characters that are no words, else -1."""
    if s.startswith(PREFIXES) or len(s) >= 16 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", s):
        return 1
    return 1 if not SPELLED.fullmatch(s) and len(set(s)) >= min(16, 2 * len(s) // 3) else -1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: the part before the sign reaches back as far as it can, but not into the match before."""
    done, sign = 0, text.find("@")
    while sign >= 0:
        start = sign
        while start > done and (m := LOCAL.search(text, max(done, start - 64), start)):
            start = m.start()
        if start < sign and (m := DOMAIN.match(text, sign + 1)):
            yield start, m.end()
            done = m.end()
        sign = text.find("@", max(sign + 1, done))


def strict(text: str) -> list[tuple[int, int, str]]:
    """Base spans by start, then kind."""
    out = [(a, b, "email") for a, b in emails(text)]
    if re.search("[0-9]", text):
        out += [(*m.span(), "ip") for m in IP.finditer(text) if checked("ip", m[0]) > 0]
        out += [(*m.span(), "card") for m in CARD.finditer(text) if m.end() - m.start() >= 14 and checked("card", m[0]) > 0]
        out += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def loose(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of the looser patterns that meet no base span and none of an earlier pattern."""
    if not re.search("[0-9]", text):
        return []
    out, own = [], list(taken)
    for kind, pattern in LOOSE:
        new = [(*m.span(pattern.groups), kind) for m in pattern.finditer(text)]
        own.sort()
        ends, starts = np.array([x[1] for x in own]), np.array([x[0] for x in own])
        if len(own):
            ends = np.maximum.accumulate(ends)
        for a, b, k in new:
            i = int(np.searchsorted(starts, b)) if len(own) else 0
            if i == 0 or ends[i - 1] <= a:
                out.append((a, b, k))
        own += out
    return out


def votes(text: str, a: int, b: int, kind: str, base: bool) -> tuple[int, ...]:
    """Each labeler's 1, -1 or 0, then features of the span: length, share of digits, marks on its sides."""
    s = text[a:b]
    near = {w.lower() for w in WORD.findall(text[max(0, a - NEAR) : a])}
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if s.rpartition(".")[2].lower() in ENDINGS.split() else 0
    elif kind == "ip":
        gazetteer = -1 if s.startswith(("0.", "127.")) else 1
    elif kind == "phone":
        gazetteer = dialled(s)
    elif kind == "iban":
        gazetteer = 1 if IBANS.get(s[:2]) == str(len(s.replace(" ", ""))) else -1
    elif kind == "secret":
        gazetteer = looks_secret(s)
    context = 1 if near & set(BEFORE[kind].split()) else -1 if near & set(NUMBERS.split()) else 0
    left, right = text[a - 1 : a], text[b : b + 1]
    touch = -1 if left.isalnum() or right.isalnum() else 1 if base or (left in "\"'=:([<" and right in "\"')]>;,.") else 0
    digits = sum("0" <= c <= "9" for c in s)
    return (checked(kind, s), gazetteer, context, touch, min(7, len(s) // 6), 4 * digits // len(s), int(left in "\"'=:"), int(base))


def candidates(text: str | None) -> list[tuple[int, int, str, bool, tuple[int, ...]]]:
    if not text:
        return []
    base = strict(text)
    found = [(*x, True) for x in base] + [(*x, False) for x in loose(text, base)]
    return [(a, b, k, ok, votes(text, a, b, k, ok)) for a, b, k, ok in sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))]


class Model:
    """Which patterns of kind, votes and features are personal data."""

    def __init__(self, counts: Counter):
        self.names = sorted(counts)
        n = np.array([counts[x] for x in self.names], dtype=np.float64)
        self.posterior, self.accuracy = self.agree(n)
        self.accepted: set[tuple] = set()
        if self.names:
            x = np.array([self.features(p) for p in self.names])
            self.weights = self.train(x, n, self.posterior)
            self.accepted = {p for p, s in zip(self.names, x @ self.weights, strict=True) if s >= 0}

    @staticmethod
    def features(pattern: tuple) -> list[float]:
        kind, v = pattern[0], pattern[1:]
        return [1.0, *(float(kind == k) for k in KINDS), *(float(v[i]) for i in range(LABELERS)), *(float(v[i] != 0) for i in range(LABELERS)), v[4] / 7, v[5] / 4, float(v[6]), float(v[7])]

    def agree(self, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior of each pattern and each labeler's accuracy where it votes; the first guess is the majority.

        A labeler that is wrong more often than right then counts the other way round. That a base span is one is certain
        and fixes which of the two classes is which.
        """
        kinds = np.array([KINDS.index(p[0]) for p in self.names], dtype=int)
        v = np.array([[*p[1 : 1 + LABELERS], p[8]] for p in self.names], dtype=int).reshape(len(self.names), LABELERS + 1)
        q = 1 / (1 + np.exp(-v.sum(axis=1).astype(float)))
        right = np.full(LABELERS + 1, 0.8)
        right[LABELERS] = 0.98
        for _ in range(STEPS):
            for j in range(LABELERS):
                cast = v[:, j] != 0
                good = (n * np.where(v[:, j] > 0, q, 1 - q))[cast].sum()
                right[j] = np.clip((good + 8) / (n[cast].sum() + 10), 0.02, 0.98)
            prior = np.array([((n * q)[kinds == k].sum() + 1) / (n[kinds == k].sum() + 2) for k in range(len(KINDS))])
            prior = np.clip(prior, 0.001, 0.999)
            logit = np.log(prior / (1 - prior))[kinds] + v @ np.log(right / (1 - right))
            q = 1 / (1 + np.exp(-logit))
        return q, right

    @staticmethod
    def train(x: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Logistic regression on soft labels, each pattern as often as it occurs, by Newton steps with a ridge."""
        w = np.zeros(x.shape[1])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (q - p)) - w
            bend = (x * (n * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
            w = w + np.linalg.solve(bend, slope)
        return w


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Counts the candidates of all rows by pattern."""
    bound_batches(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n.update((k, *v) for _, _, k, _, v in candidates(t))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in n], pa.string()), pa.array([x[1:] for x in n], pa.list_(pa.int32())), pa.array(n.values(), pa.int64(), size=len(n))], names=["kind", "v", "n"])

    rows = docs.select(F.col(text)).mapInArrow(lean(tally), "kind string, v array<int>, n long").groupBy("kind", "v").agg(F.sum("n").alias("n")).collect()
    return Model(Counter({(r["kind"], *r["v"]): r["n"] for r in rows}))


def spans_of(text: str | None, model: Model) -> list[tuple[int, int, str, bool]]:
    """Base spans and the candidates that the model accepts, by start, then kind."""
    return [(a, b, k, base) for a, b, k, base, v in candidates(text) if base or (k, *v) in model.accepted]


def find(docs: DataFrame, text: str = "text", key: str = "doc_id", model: Model | None = None) -> DataFrame:
    """One row a document: key and spans, an array of kind, start, end (code points, exclusive) and base.

    A text that is null, empty or without personal data has an empty array; a text of any length is searched whole, and
    repeated rows each get theirs. No rows in, no rows out. The model is fitted on docs unless given. Other columns of docs are neither read nor returned.
    """
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b, "base": base} for a, b, k, base in spans_of(t, shared.value)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=[key, "spans"])

    rows = docs.select(key, text)
    return rows.mapInArrow(lean(work), f"`{key}` {dict(rows.dtypes)[key]}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def redacted(text: str, spans: list[tuple[int, int, str, bool]]) -> str:
    """The text with each span, or group of spans that meet, replaced by the first one's kind in angle brackets."""
    out, done, until = [], 0, -1
    for a, b, kind, _ in spans:
        if a >= until:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = until = max(until, b)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text: str = "text", length: str | None = None) -> DataFrame:
    """docs with its personal data replaced; length names a column that holds the text's code points.

    A null text stays null, an empty one empty; texts of any length are redacted whole, repeated rows alike. All other
    columns, whatever their names, stay as they are. No rows in, no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, text))
    names = docs.columns
    at, size = names.index(text), names.index(length) if length else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t and redacted(t, spans_of(t, shared.value)) for t in batch.column(at).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(new, columns[at].type)
            if size is not None:
                columns[size] = pa.array([None if t is None else len(t) for t in new], columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(lean(work), docs.schema)


def digest(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(read(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS[:STRICT]), F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
