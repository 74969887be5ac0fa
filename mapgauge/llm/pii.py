"""Personal data by weak supervision.

Base spans (e-mail, IP address, payment card, phone) follow fixed patterns and always stay. Further candidates (secrets,
national numbers, IBANs, national phone numbers, spelt-out e-mail addresses) are proposed by patterns, and names by a
gazetteer of given names and surnames, by a title or by words such as 'my name is'. Labelers (format, gazetteer: names and
places, known domains or a check of characters, context before, contrary context, shape, borders) vote for, against or
abstain on every candidate; expectation-maximisation over the counts of vote patterns estimates each labeler's reliability and the
posterior of each pattern; a logistic span classifier is trained on these posteriors and decides on the candidates that
aren't base spans. Counts come from all candidates; the classifier is fitted on at most about FIT_SPANS of them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapgauge.llm.common import cut, table, text_of
from mapgauge.llm.gazetteers import GIVEN, PLACES, SURNAMES

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "national_id", "iban", "local_phone", "spelt_email", "name")
KINDS = BASE + ADDED
LABELERS = ("format", "gazetteer", "context", "contrary", "shape", "border")
FIT_SPANS = 20_000
FEATURES = 512
CONTEXT = 28

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A run of digits is tried once, from its start: its later digits can't start a match where the first didn't.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Of any length; a run is looked through once, from its start.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SPELT = re.compile(r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63} ?[\[(]dot[\])] ?[A-Za-z]{2,24}(?![A-Za-z])")
#: Capitalised words in a row, of which names are cut (names).
_CAPITALS = re.compile(r"(?<![\w'])[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,30}+(?:[ -][A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,30}+)*+(?!\w)")
_TITLES = frozenset("Mr Mrs Ms Dr Prof".split())
_TITLE = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof)\.? $")
_CUE = re.compile(r"(?:name is|name:|named|called|signed,?|signed by|regards,|sincerely,|dear) $", re.IGNORECASE)

_DOMAINS = frozenset("com org net edu gov info io de fr es uk eu us".split())
_CONTEXT = {
    "email": "mail contact write", "ip": "ip address host from server login", "card": "card visa pay credit account",
    "phone": "phone tel call mobile fax contact", "secret": "token key secret password passwd pwd auth bearer", "national_id": "ssn social id number",
    "iban": "iban account bank", "local_phone": "phone tel call mobile fax contact", "spelt_email": "mail contact write", "name": "name dear signed author from mr mrs ms dr prof regards sincerely",
}
_CONTEXT = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v.split()) + ")") for k, v in _CONTEXT.items()}
_CONTRARY = re.compile(r"(?<![a-z])(?:version|isbn|commit|sha1|sha256|md5|page|figure|build|release|checksum|hash)[^a-z]{0,4}$")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern from left to right. An address starts where the run of local characters before its @
    starts, or where the last match ended; the pattern itself would try each character of each run."""
    last, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        # what is before this @ can't be part of a later match's local part, which holds no @
        last = m.end() if m else at + 1
        if m:
            yield s, m.end()
        at = text.find("@", last)


def _part(p: str) -> bool:
    p = p.lstrip("0")
    return len(p) <= 3 and int(p or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base spans, in order."""
    out = [(s, 0, e) for s, e in emails(text)]
    if not re.search("[0-9]", text):
        return out
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_part, m.group().split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    out.sort()
    return out


def names(text: str, given=GIVEN, surnames=SURNAMES) -> Iterator[tuple[int, int]]:
    """Where a name may be: in capitalised words from the first that follows a title or cue, or is a given name, or from the
    one before a surname; two more words at most."""
    for m in _CAPITALS.finditer(text):
        words = [(w.start() + m.start(), w.end() + m.start(), w.group()) for w in re.finditer(r"[^ -]+", m.group())]
        before = text[max(0, m.start() - 20) : m.start()]
        first = 0 if _TITLE.search(before) or _CUE.search(before) else None
        for k, (_, _, w) in enumerate(words):
            if first is not None:
                break
            if w in _TITLES and k + 1 < len(words):
                first = k + 1
            elif w in given:
                first = k
            elif w in surnames and k:
                first = k - 1
        while first is not None and first < len(words) and words[first][2] in _TITLES:
            first += 1
        if first is not None and first < len(words):
            yield words[first][0], words[min(first + 2, len(words) - 1)][1]


def more_candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates of the added kinds that overlap no base span and, among themselves, no earlier one."""
    found = []
    digits = re.search("[0-9]", text) is not None
    for kind, pattern, use in ((4, _SECRET, digits), (5, _NATIONAL, digits), (6, _IBAN, digits), (7, _LOCAL_PHONE, digits), (8, _SPELT, "at" in text and "dot" in text)):
        if use:
            found += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
    found += [(s, 9, e) for s, e in names(text)]
    out: list[tuple[int, int, int]] = []
    taken = sorted((s, e) for s, _, e in base)
    i = 0
    # of candidates with the same start the more specific kind
    for s, kind, e in sorted(found, key=lambda x: (x[0], x[1] == 4, x[1])):
        while i < len(taken) and taken[i][1] <= s:
            i += 1
        if (i < len(taken) and taken[i][0] < e) or (out and out[-1][2] > s):
            continue
        out.append((s, kind, e))
    return out


def _entropy(s: str) -> float:
    _, n = np.unique(list(s), return_counts=True)
    p = n / n.sum()
    return float(-(p * np.log2(p)).sum())


def votes(text: str, s: int, kind: int, e: int) -> str:
    """One letter a labeler: + for, - against, 0 abstains."""
    name, span = KINDS[kind], text[s:e]
    digits = "".join(c for c in span if "0" <= c <= "9")
    before = text[max(0, s - CONTEXT) : s].lower()
    if name == "email":
        fmt = span.rsplit(".", 1)[1].isalpha()
        gaz = span.rsplit(".", 1)[1].lower() in _DOMAINS
    elif name == "ip":
        first = int(span.split(".")[0].lstrip("0") or "0")
        fmt, gaz = first not in (0, 127, 255), 1 <= first <= 223
    elif name == "card":
        fmt, gaz = len(digits) in (13, 14, 15, 16, 19), digits[0] in "23456"
    elif name == "secret":
        fmt, gaz = _entropy(span) >= 3, len(set(span)) >= 10
    elif name == "iban":
        moved = span[4:] + span[:4]
        fmt, gaz = int("".join(str(int(c, 36)) for c in moved)) % 97 == 1, True
    elif name == "national_id":
        fmt, gaz = digits[:3] not in ("000", "666") and digits[3:5] != "00", digits[0] != "9"
    elif name == "name":
        words = re.findall(r"[^ -]+", span)
        known, place = sum(w in GIVEN or w in SURNAMES for w in words), any(w in PLACES for w in words)
        fmt, gaz = len(words) > 1 or known > 0, known > 0 and not place
    else:
        fmt, gaz = True, name != "local_phone" or digits[0] not in "01"
    context = "+" if _CONTEXT[name].search(before) else "0"
    contrary = "-" if _CONTRARY.search(before) else "0"
    shape = "-" if digits and len(set(digits)) <= 2 and len(digits) > 4 else "+"
    glued = (s > 0 and text[s - 1].isalnum()) or (e < len(text) and text[e].isalnum())
    return ("+" if fmt else "-") + ("+" if gaz else "-") + context + contrary + shape + ("-" if glued else "+")


def _features(text: str, s: int, kind: int, e: int, vote: str) -> list[int]:
    """Hashed features of a span: kind, votes, length, share of digits, words before."""
    span = text[s:e]
    keys = [f"k{kind}", f"l{min((e - s) // 4, 20)}", f"d{int(4 * sum(c.isdigit() for c in span) / (e - s))}", *(f"v{i}{v}" for i, v in enumerate(vote)), *(f"w{w}" for w in re.findall("[a-z]+", text[max(0, s - CONTEXT) : s].lower())[-3:])]
    return sorted({int.from_bytes(hashlib.blake2b(k.encode(), digest_size=4).digest(), "big") % FEATURES for k in keys})


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = 60) -> dict[tuple[int, str], float]:
    """Expectation-maximisation over vote patterns by kind: the posterior that a span of this kind and pattern is personal
    data. Labelers have a probability of each vote for either class, shared by kinds; each kind has a prior of its own."""
    keys = list(counts)
    if not keys:
        return {}
    n = np.array([counts[k] for k in keys], float)
    kind = np.array([k for k, _ in keys])
    v = np.array([["-0+".index(c) for c in p] for _, p in keys])
    # start from the majority of votes
    post = 1 / (1 + np.exp(-(v - 1).sum(axis=1).astype(float)))
    for _ in range(rounds):
        logs = []
        for weight in (post * n, (1 - post) * n):
            table = np.ones((v.shape[1], 3)) * 0.5
            for j in range(v.shape[1]):
                np.add.at(table[j], v[:, j], weight)
            table /= table.sum(axis=1, keepdims=True)
            logs.append(np.log(table[np.arange(v.shape[1]), v]).sum(axis=1))
        total, yes = np.bincount(kind, n, len(KINDS)), np.bincount(kind, n * post, len(KINDS))
        prior = ((yes + 1) / (total + 2))[kind]
        new = 1 / (1 + np.exp(np.clip(np.log(1 - prior) + logs[1] - np.log(prior) - logs[0], -30, 30)))
        if abs(new - post).max() < 1e-6:
            break
        post = new
    return {k: float(p) for k, p in zip(keys, post, strict=True)}


def fit_classifier(rows: list[list[int]], target: np.ndarray, times: np.ndarray | None = None, epochs: int = 200) -> np.ndarray:
    """Weights of a logistic model with an L2 penalty, the bias last, by full gradient steps on soft labels. times: how often
    each row occurs."""
    w = np.zeros(FEATURES + 1)
    if not rows:
        return w
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    share = np.ones(len(rows)) / len(rows) if times is None else times / times.sum()
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ ((p - target) * share) + 1e-4 * w)
    return w


def _text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_pii(docs: DataFrame, id_col="doc_id", text_col="text", fit_spans: int = FIT_SPANS) -> DataFrame:
    """A row a document: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end in code points, by start and
    then kind, comma-joined), n_added. Null text is empty and has no spans; other columns are ignored; an empty table gives
    no rows. A repeated row gives equal rows; for the classifier it counts as often as it occurs."""
    kept = docs.select(F.col(f"`{id_col}`").alias("id"), text_of(text_col).alias("text"))
    id_type = kept.schema["id"].dataType.simpleString()
    names = ["id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "cand"]
    cand_type = pa.list_(pa.struct([("s", pa.int64()), ("kind", pa.int32()), ("e", pa.int64()), ("vote", pa.string()), ("found", pa.list_(pa.int32()))]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                text = t.as_py()
                base = base_spans(text)
                added = more_candidates(text, base)
                cand = []
                for s, k, e in base + added:
                    vote = votes(text, s, k, e)
                    cand.append({"s": s, "kind": k, "e": e, "vote": vote, "found": _features(text, s, k, e, vote)})
                joined = _text(base)
                rows.append((*(sum(k == i for _, k, _ in base) for i in range(4)), hashlib.sha256(joined.encode()).hexdigest(), joined, cand))
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), cand_type]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    cand_sql = "array<struct<s:bigint,kind:int,e:bigint,vote:string,found:array<int>>>"
    schema = f"id {id_type}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, base string, cand {cand_sql}"
    seen = cut(kept.mapInArrow(label, schema))
    spans = seen.select(F.explode("cand").alias("c"), "id")
    counts = {(r["kind"], r["vote"]): r["n"] for r in spans.groupBy("c.kind", "c.vote").agg(F.count(F.lit(1)).alias("n")).collect()}
    posterior = reliabilities(counts)
    share = min(1.0, fit_spans / max(sum(counts.values()), 1))
    draw = F.pmod(F.xxhash64(F.lit(31), "id", "c.s", "c.kind"), F.lit(1_000_000)) / 1e6
    # equal spans count together, so a row that is repeated adds weight and no rows
    sample = spans.where(draw < share).groupBy("c.kind", "c.vote", "c.found").agg(F.count(F.lit(1)).alias("n")).collect()
    sample.sort(key=lambda r: (r["kind"], r["vote"], r["found"]))
    weights = fit_classifier([r["found"] for r in sample], np.array([posterior[r["kind"], r["vote"]] for r in sample]), np.array([r["n"] for r in sample]))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, added = [], []
            for cand in batch.column(7):
                cand = cand.as_py()
                yes = [(c["s"], c["kind"], c["e"]) for c in cand if c["kind"] < len(BASE) or weights[c["found"]].sum() + weights[-1] >= 0]
                out.append(_text(sorted(yes)))
                added.append(sum(k >= len(BASE) for _, k, _ in yes))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(out, pa.string()), pa.array(added, pa.int64())], names=[*names[:6], "spans", "n_added"])

    out = seen.mapInArrow(decide, f"id {id_type}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_added long")
    return out.withColumnRenamed("id", id_col)


def op6_pii(spark, sf_dir):
    return find_pii(table(spark, sf_dir, "documents"))
