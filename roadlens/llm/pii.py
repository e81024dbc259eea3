"""Personal data by weak supervision.

One Arrow pass finds the base spans (fixed patterns and checks) and candidates around them: what the
patterns reject, spelled-out addresses, national numbers without a plus sign, identity numbers and
secrets.  Labelers vote on every span, for (1), against (-1) or not at all (0): the pattern's own
check, gazetteers (top-level domains, reserved networks, issuer and country prefixes), the words before
the span, and its shape.  Votes and shape make a *pattern* out of a small fixed set, so all spans of
the corpus are counted per pattern; on these counts expectation-maximisation estimates for each kind how
often it is true and how reliable every labeler is, and the posteriors train the final classifier, a
logistic regression over pattern features.  Base spans always stay; candidates are added when the
classifier says at least ``least``.

Scale: texts are read once and never shuffled; spans stay in their document's row; pattern counts are
combined before the shuffle and number at most a few thousand (kinds x 3 ** labelers x shapes) at any
corpus size, which is what the driver receives.

Defined results: a null text is an empty one and has no spans; a null doc_id is passed on; repeated rows
get equal results; an empty table gives an empty table (and an untrained classifier adds nothing); other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadlens.llm import common as C

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE = 4
LABELERS = ("check", "gazetteer", "context", "shape")

LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Candidates beyond the base patterns.
SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[(\[{] ?at ?[)\]}] ?| at )[A-Za-z0-9-]{1,63}"
                     r"(?:(?: ?[(\[{] ?dot ?[)\]}] ?| dot |\.)[A-Za-z0-9-]{2,63})+(?![A-Za-z0-9-])")
NATIONAL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z-])")
IDENTITY = re.compile(r"(?<![0-9A-Za-z-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z-])")
SECRET = re.compile(r"(?<![A-Za-z0-9_/+-])[A-Za-z0-9_/+-]{20,}+")  # a whole run; it counts with a digit anywhere

#: Gazetteers.
TOP_LEVEL = set("com org net edu gov mil int info biz io co me ai app dev uk de fr es it nl be ch at se no dk fi pl pt ru "
                "cn jp kr in br mx ca us au nz za ie cz gr hu ro tr ua eu cat xyz online site tech name pro".split())
COUNTRY_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48",
                 "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82",
                 "84", "86", "90", "91", "92", "93", "94", "95", "98", "212", "213", "216", "218", "351", "352", "353", "354",
                 "358", "359", "370", "371", "372", "380", "381", "385", "386", "420", "421", "852", "886", "966", "971", "972")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|6011|65|3[47]|3[068]|35|62|50|5[6-9]|67")
#: Words that speak for a kind when they stand shortly before a span, and words that speak against any.
BEFORE = {
    "email": set("email e-mail mail contact write reply address".split()),
    "ip": set("ip host server address addr from client login ping".split()),
    "card": set("card visa mastercard amex credit debit pan payment".split()),
    "phone": set("phone tel telephone call mobile cell fax whatsapp contact sms".split()),
    "id": set("ssn social security passport iban account identity national id tax".split()),
    "secret": set("token key secret password passwd pwd apikey api bearer auth credential credentials".split()),
}
AGAINST = set("version release chapter section page figure table isbn issn doi order invoice ticket part model serial "
              "commit sha checksum hash md5 article vol volume number no count total".split())
WORDS_BEFORE = re.compile(r"[A-Za-z0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str):
    """Leftmost non-overlapping addresses: each at sign with the longest local part that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_matches(text: str):
    """(kind, start, end, passes) of the four base patterns."""
    for a, b in emails(text):
        yield 0, a, b, True
    if not DIGIT.search(text):
        return
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        yield 2, m.start(), m.end(), 16 <= len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield 3, m.start(), m.end(), 8 <= len(digits_of(m[0])) <= 15


def more_matches(text: str):
    """(kind, start, end) of candidates that the base patterns don't see."""
    if " at " in text or "at)" in text or "at]" in text or "at}" in text:
        for m in SPELLED.finditer(text):
            yield 0, m.start(), m.end()
    if DIGIT.search(text):
        for kind, pattern in ((3, NATIONAL), (4, IDENTITY), (5, SECRET)):
            for m in pattern.finditer(text):
                if kind != 5 or DIGIT.search(text, m.start(), m.end()):
                    yield kind, m.start(), m.end()


def vote(kind: int, text: str, a: int, b: int, check: int) -> tuple[int, int, int, int, int]:
    """The labelers' votes and a shape class (0 to 3) of a span."""
    span, name = text[a:b], KINDS[kind]
    words = [w.lower() for w in WORDS_BEFORE.findall(text, max(0, a - 32), a)][-3:]
    context = 1 if BEFORE[name] & set(words) else -1 if AGAINST & set(words) else 0
    d = digits_of(span)
    clear = not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    gazetteer, shape, kindred = 0, 1 if clear else -1, 0
    if kind == 0:
        last = re.split(r"[^A-Za-z0-9]+", span.rstrip(")]}. "))[-1].lower()
        gazetteer = 1 if last in TOP_LEVEL else -1
        kindred = 0 if "@" in span else 1 if any(c in span for c in "([{") else 2
        if kindred == 2 and " dot " not in span:
            shape = -1  # a plain sentence around the word "at"
    elif kind == 1:
        p = [x.lstrip("0") or "0" for x in span.split(".")]
        gazetteer = -1 if p[0] in ("0", "127", "255") or any(len(x) > 3 for x in p) else 1 if int(p[0]) < 240 else 0
        kindred = int(all(len(x) == 1 for x in p))
    elif kind == 2:
        gazetteer = 1 if ISSUERS.match(d) and 13 <= len(d) <= 19 else -1
        groups = re.split(r"[ -]", span)
        kindred = 0 if len(groups) == 1 else 1 if all(len(g) == 4 for g in groups[:-1]) and len(groups) < 6 else 2
        if not 13 <= len(d) <= 19 or kindred == 2:
            shape = -1
    elif kind == 3:
        gazetteer = (1 if any(d.startswith(c) for c in COUNTRY_CODES) else -1) if span[0] == "+" else 0
        kindred = 0 if span[0] == "+" else 1 if span[0] == "(" else 2
        if not 8 <= len(d) <= 15:
            shape = -1
    elif kind == 4:
        gazetteer = -1 if d[:3] in ("000", "666") else 0
        kindred = int(span[0].isalpha())
        if kindred:
            moved = "".join(str(int(c, 36)) for c in (span.replace(" ", "")[4:] + span[:4]).upper())
            gazetteer = 1 if int(moved) % 97 == 1 else -1
    else:
        kinds = sum((any(c.islower() for c in span), any(c.isupper() for c in span), len(d) > 2))
        spread = len(set(span)) / min(len(span), 32)
        shape = 1 if clear and kinds > 1 and spread > 0.3 else -1
        quoted = a and text[a - 1] in "\"'=:"
        gazetteer = 1 if quoted or span[:3] in ("sk-", "ghp", "AKI", "eyJ") else -1 if "/" in span or span.count("-") > 3 else 0
        kindred = int(all(c in "0123456789abcdef" for c in span))
    return check, gazetteer, context, shape, kindred


def code_of(kind: int, votes: tuple[int, ...]) -> int:
    """Kind, votes and shape class as one number."""
    x = kind
    for v in votes[:4]:
        x = x * 3 + v + 1
    return x * 4 + votes[4]


def decode(code: int) -> tuple[int, list[int], int]:
    code, shape = divmod(code, 4)
    votes = []
    for _ in range(4):
        code, v = divmod(code, 3)
        votes.append(v - 1)
    return code, votes[::-1], shape


def spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, is base, pattern) of all base spans and candidates, by kind, then start."""
    out = []
    for kind, a, b, ok in base_matches(text):
        if ok or (kind == 2 and 13 <= len(digits_of(text[a:b])) <= 19) or (kind == 3 and b - a < 40) or kind == 1:
            short = kind == 2 and not ok and len(d := digits_of(text[a:b])) < 16 and luhn(d)
            out.append((kind, a, b, int(ok), code_of(kind, vote(kind, text, a, b, 1 if ok or short else -1))))
    base = sorted((a, b) for _, a, b, ok, _ in out if ok)
    starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))  # the furthest end of the spans so far
    for kind, a, b in more_matches(text):
        i = bisect_left(starts, b)
        if not i or reach[i - 1] <= a:  # not over a base span
            out.append((kind, a, b, 0, code_of(kind, vote(kind, text, a, b, 0))))
    return sorted(out)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, kinds, starts, ends, base, patterns): the spans of every document."""
    names = ["kinds", "starts", "ends", "base", "patterns"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = batch.column(0).slice(at, 256), batch.column(1).slice(at, 256).to_pylist()
                found = [spans(t) if t else [] for t in texts]
                cols = [pa.array([[s[i] for s in f] for f in found], type=pa.list_(pa.int32())) for i in range(5)]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", *names])

    schema = "doc_id long, " + ", ".join(f"{n} array<int>" for n in names)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def reliabilities(counts: dict[int, int], rounds: int = 50) -> dict[int, tuple[float, np.ndarray]]:
    """Per kind: (share of true spans, table [labeler, vote + 1, truth] of vote probabilities) by EM,
    with one pseudo-count a cell and a start from the sign of the votes' sum."""
    out = {}
    for kind in range(len(KINDS)):
        rows = [(decode(c)[1], n) for c, n in counts.items() if decode(c)[0] == kind]
        if not rows:
            continue
        votes = np.array([v for v, _ in rows]) + 1
        n = np.array([c for _, c in rows], dtype=float)
        true = 1 / (1 + np.exp(-2.0 * (votes - 1).sum(axis=1)))
        for _ in range(rounds):
            share = (n @ true + 1) / (n.sum() + 2)
            table = np.ones((len(LABELERS), 3, 2))
            for k in range(len(LABELERS)):
                # a vote for a span is taken to be likelier on true ones: the prior keeps the classes' names
                table[k, 2, 1] += 2
                table[k, 0, 0] += 2
                np.add.at(table[k, :, 1], votes[:, k], n * true)
                np.add.at(table[k, :, 0], votes[:, k], n * (1 - true))
            table /= table.sum(axis=1, keepdims=True)
            log1, log0 = np.log(share), np.log(1 - share)
            for k in range(len(LABELERS)):
                log1 = log1 + np.log(table[k, votes[:, k], 1])
                log0 = log0 + np.log(table[k, votes[:, k], 0])
            true = 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))
        out[kind] = (share, table)
    return out


def features(code: int) -> np.ndarray:
    """One-hot kind, and votes and shape class within the kind."""
    kind, votes, shape = decode(code)
    x = np.zeros(len(KINDS) * (1 + 3 * len(LABELERS) + 4))
    at = kind * (1 + 3 * len(LABELERS) + 4)
    x[at] = 1
    for k, v in enumerate(votes):
        x[at + 1 + 3 * k + v + 1] = 1
    x[at + 1 + 3 * len(LABELERS) + shape] = 1
    return x


def train(counts: dict[int, int], steps: int = 400, ridge: float = 1e-3) -> dict[int, float]:
    """The final classifier's probability of every pattern: logistic regression on EM posteriors, each
    pattern weighted by the logarithm of its count."""
    if not counts:
        return {}
    model, codes = reliabilities(counts), sorted(counts)
    soft = []
    for code in codes:
        kind, votes, _ = decode(code)
        share, table = model[kind]
        odds = np.log(share / (1 - share)) + sum(np.log(table[k, v + 1, 1] / table[k, v + 1, 0]) for k, v in enumerate(votes))
        soft.append(1 / (1 + np.exp(-np.clip(odds, -30, 30))))
    x, y = np.array([features(c) for c in codes]), np.array(soft)
    weight = np.log1p(np.array([counts[c] for c in codes], dtype=float))
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return {c: float(1 / (1 + np.exp(-f @ w))) for c, f in zip(codes, x)}


def pattern_counts(found: DataFrame) -> dict[int, int]:
    """Spans per pattern over the whole corpus: at most 6 * 3 ** 4 * 4 rows."""
    rows = found.select(F.explode("patterns").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect()
    return {r["p"]: r["n"] for r in rows}


def label(found: DataFrame, accepted: set[int]) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of rows of ``find``."""
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for kinds, starts, ends, base, patterns in zip(*(c.to_pylist() for c in batch.columns[1:])):
                rows = list(zip(kinds, starts, ends, base, patterns))
                own = [r for r in rows if r[3]]
                for k in range(BASE):
                    out[k].append(sum(r[0] == k for r in own))
                out[4].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, _, _ in own).encode()).hexdigest())
                out[5].append(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, ok, p in rows if ok or p in accepted))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, type=pa.int64()) for c in out[:4]), *(pa.array(c, type=pa.string()) for c in out[4:])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def detect(docs: DataFrame, least: float = 0.8) -> DataFrame:
    found = C.saved(find(docs), "pii")
    model = train(pattern_counts(found))
    return label(found, {c for c, p in model.items() if p >= least})


def op4_pii(spark, sf_dir: str) -> DataFrame:
    return detect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
