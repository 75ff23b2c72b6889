"""Personal data: labelers vote, expectation-maximisation weighs them, a classifier decides spans.

Base spans (e-mail, IP, card, phone) follow fixed patterns and always stay. Further candidates are secrets and
identifiers: values behind a key word, access-key shapes, long hex or mixed tokens, IBAN-like codes, e-mail
addresses and numbers written apart. Each candidate gets votes (yes, no, abstain) from

* regex labelers: the shape of the value (known prefix, hex, mixed classes, grouped digits),
* gazetteer labelers: words that introduce such values, words and placeholders that never are one, and lists of
  country codes of account numbers and of ends of host names, and
* context labelers: what stands around it (assignment signs, quotes, digits only beside a unit or a year).

Patterns of votes and shape (length, share of digits, entropy, changes of character class, each in a few steps) of all
candidates in all documents are counted. Expectation-maximisation (two classes, labelers independent given the class)
estimates each labeler's reliability from the votes and gives every pattern a posterior. A logistic span classifier
over votes and shape is trained on the patterns with these posteriors as soft targets; a candidate becomes
a span at probability `cut` or above. Patterns are few (a bound by the number of labelers and steps), whatever the corpus.

Defined cases: null and empty text has no spans; repeated rows each get a row; a base match inside another kind stays (kinds
are found apart); of an added span that meets base spans, the parts of four characters or more beside them stay; one that
meets an earlier added one is left out; of candidates with one start the longest counts; values and texts have no greatest
length; without candidates no span is added; an empty table gives an empty result; further columns are not read by the
query and kept by the stage, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from operator import ne

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quire.llm.common import map_rows
from quire.session import written

# The base patterns.
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
DIGIT = re.compile("[0-9]")

# Words before a value that is personal or secret, and words that are no value.
KEYS = ("password", "passwd", "pwd", "passphrase", "token", "secret", "api_key", "apikey", "api-key", "access_key", "auth", "bearer", "ssn", "iban", "pin", "passport", "licence", "license")
NO_VALUE = ("true", "false", "none", "null", "yes", "no", "required", "optional", "version")
PLACEHOLDERS = ("example", "changeme", "placeholder", "your_", "your-", "xxxx", "****", "<", "${", "%s")
# Countries whose account numbers begin with their code, and frequent ends of host names.
COUNTRIES = frozenset("AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK".split())
HOST_ENDS = frozenset("com org net edu gov mil int info biz name io dev app ai co me tv eu uk us ca au nz ie de at ch fr be nl lu es pt it pl cz sk hu ro bg gr se no dk fi is ru ua tr il in cn jp kr br mx ar za example test invalid".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "glpat-")

#: Anything that might be added: a keyed value, a prefixed key, a long hex or mixed token, an IBAN shape, an address written apart.
KEYED = re.compile(r"(?i)\b(password|passwd|pwd|passphrase|token|secret|api[_-]?key|access[_-]?key|auth|bearer|ssn|iban|pin|passport)\b[\"']?\s{0,2}(?:[:=]|is\b)\s{0,2}[\"']?([^\s\"'<>,;]{4,}+)")
SHAPED = re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\b(?:ghp_|gho_|github_pat_|sk-|sk_live_|pk_live_|xox[bp]-|AIza|glpat-)[A-Za-z0-9_-]{12,}+|\b[0-9a-f]{20,}+\b|\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b|\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
APART = re.compile(r"(?i)\b[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[a-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[a-z0-9-]{1,63}){1,4}")
CLUES = ("pass", "token", "secret", "pwd", "key", "auth", "bearer", "ssn", "iban", "pin")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

LABELERS = ("keyed", "prefixed", "hex", "mixed", "grouped", "no_value", "listed", "assigned", "quoted", "plain_word")
#: How many shape steps follow the votes.
SHAPE = 4


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @; linear in any text."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base, by kind as listed, then by start."""
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text) is None:
        return found
    if "." in text:
        found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(DIGIT.findall(m.group())) <= 15]
    return found


def shape(value: str) -> str:
    """Steps of length, share of digits, entropy a character and changes of character class."""
    size, counts = len(value), Counter(value)
    digits = sum(counts[d] for d in "0123456789")
    entropy = -sum(n / size * math.log2(n / size) for n in counts.values())
    classes = [0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3 for c in value]
    changes = sum(map(ne, classes, classes[1:])) / max(1, size - 1)
    return f"{min(4, max(0, size.bit_length() - 3))}{min(3, 4 * digits // size)}{min(4, int(entropy))}{min(3, int(6 * changes))}"


def listed(value: str) -> str:
    """What the gazetteers say of a value."""
    low = value.lower()
    if any(p in low for p in PLACEHOLDERS):
        return "n"
    if value[:2].isupper() and value[2:4].isdigit():
        return "y" if value[:2] in COUNTRIES else "-"
    if "at)" in low or "at]" in low:
        return "y" if re.split(r"[^a-z0-9-]+", low)[-1] in HOST_ENDS else "-"
    return "-"


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern): all candidates beside the base in order; a pattern has y, n or - for each of LABELERS, then the shape."""
    lower, spans = text.lower(), {}
    if any(c in lower for c in CLUES):
        spans |= {m.span(2): True for m in KEYED.finditer(text)}
    if DIGIT.search(text) or any(c in text for c in PREFIXES):
        spans |= {m.span(): m.span() in spans for m in SHAPED.finditer(text)}
    if "(at)" in lower or "[at]" in lower:
        spans |= {m.span(): False for m in APART.finditer(text)}
    found, last = [], -1
    for (a, b), keyed in sorted(spans.items(), key=lambda s: (s[0][0], -s[0][1])):
        while b > a and text[b - 1] in ".,;:!?)]}":
            b -= 1
        if a < last or b - a < 4:
            continue
        last = b
        value, before = text[a:b], text[max(0, a - 24) : a]
        classes = sum(bool(re.search(c, value)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
        hexed = re.fullmatch("[0-9a-fA-F]+", value) is not None
        digits = sum(c.isdigit() for c in value)
        votes = (
            "y" if keyed or re.search(r"(?i)(?:" + "|".join(KEYS) + r")\W{0,6}$", before) else "-",
            "y" if value.startswith(PREFIXES) else "-",
            "y" if hexed and len(value) >= 16 and digits else "-",
            "y" if classes >= 2 and digits >= 2 and len(value) >= 8 else "n" if not digits else "-",
            "y" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}[0-9A-Z ]{12,}", value) or "at)" in value.lower() or "at]" in value.lower() else "-",
            "n" if value.lower() in NO_VALUE else "-",
            listed(value),
            "y" if re.search(r"[=:]\s{0,2}[\"']?$", before) else "-",
            "y" if before[-1:] in "\"'" and before else "-",
            "n" if value.isalpha() else "y" if digits else "-",
        )
        found.append((a, b, "".join(votes) + shape(value)))
    return found


def expectation_maximisation(patterns: list[str], counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(posterior of each pattern, reliability of each labeler: how often its vote is right when it votes)."""
    votes = np.array([[{"y": 1, "n": 0, "-": 2}[v] for v in p] for p in patterns])
    good = np.clip((votes == 1).sum(1) / np.maximum(1, (votes != 2).sum(1)), 0.05, 0.95)  # majority vote
    lean = 1 + 0.05 * counts.sum()  # so much of a prior has yes with the right class and no with the other
    for _ in range(rounds):
        logs = []
        for w, says in ((good * counts, 1), ((1 - good) * counts, 0)):
            chance = lambda j: np.array([w[votes[:, j] == v].sum() + 1 + lean * (v == says) for v in range(3)]) / (w.sum() + 3 + lean)  # noqa: B023, E731
            logs.append(np.log((w.sum() + 1) / (counts.sum() + 2)) + sum(np.log(chance(j)[votes[:, j]]) for j in range(votes.shape[1])))
        good = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -30, 30)))
    right = np.array([(((votes[:, j] == 1) * good + (votes[:, j] == 0) * (1 - good)) * counts).sum() / max(1e-9, ((votes[:, j] != 2) * counts).sum()) for j in range(votes.shape[1])])
    return good, right


def _features(patterns: list[str]) -> np.ndarray:
    k = len(LABELERS)
    return np.array([[float(v == "y") for v in p[:k]] + [float(v == "n") for v in p[:k]] + [int(v) / 4 for v in p[k:]] + [1.0] for p in patterns])


def train(patterns: list[str], counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of the span classifier: logistic regression on soft targets."""
    k = len(LABELERS)
    if not len(patterns):
        return np.zeros(2 * k + SHAPE + 1)
    x = _features(patterns)
    votes, own = np.unique([p[:k] for p in patterns], return_inverse=True)
    good, right = expectation_maximisation(votes.tolist(), np.bincount(own, counts))
    target = good[own]
    # the prior says what the words mean: yes counts for, no against; each by its labeler's reliability. Shape has none
    prior = np.concatenate((2 * right, -2 * right, np.zeros(SHAPE), [-2.0]))
    w, share = prior.copy(), counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 1.0 * (x.T @ ((p - target) * share) + 0.02 * (w - prior))
    return w


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, base (kind:start:end, comma-joined), found (start:end:pattern, comma-joined): one pass over the texts."""
    own = docs.select("doc_id").schema["doc_id"]
    schema = StructType([own, StructField("base", StringType()), StructField("found", StringType())])

    def run(ids, texts):
        base = [_joined(base_spans(t)) if t else "" for t in texts]
        found = [",".join(f"{a}:{b}:{v}" for a, b, v in candidates(t)) if t else "" for t in texts]
        return {own.name: ids, "base": base, "found": found}

    return written(map_rows(docs, ["doc_id", "text"], run, schema), "pii-scan")


def learn(scanned: DataFrame) -> np.ndarray:
    """The classifier, from the patterns of every candidate of every document; a row for each distinct pattern arrives."""
    votes = scanned.where("found != ''").select(F.explode(F.split("found", ",")).alias("one")).select(F.element_at(F.split("one", ":"), -1).alias("votes"))
    rows = votes.groupBy("votes").count().orderBy("votes").collect()
    return train([r["votes"] for r in rows], np.array([r["count"] for r in rows], float))


def added(found: list[tuple[int, int, str]], base: list[tuple[str, int, int]], weights: np.ndarray, cut: float) -> list[tuple[str, int, int]]:
    """The method's own spans, kind secret or ident; none meets a base span, what stands beside one stays."""
    if not found:
        return []
    sure = 1 / (1 + np.exp(-np.clip(_features([v for _, _, v in found]) @ weights, -30, 30)))
    taken = sorted((a, b) for _, a, b in base)
    out, i, reach = [], 0, 0  # reach: the greatest end of the base spans that start at or before here
    for (a, b, votes), p in zip(found, sure):
        while i < len(taken) and taken[i][0] <= a:
            reach = max(reach, taken[i][1])
            i += 1
        if p < cut:
            continue
        kind, at = "ident" if votes[LABELERS.index("grouped")] == "y" else "secret", max(a, reach)
        j = i
        while True:
            x, y = taken[j] if j < len(taken) and taken[j][0] < b else (b, b)
            if x - at >= 4:
                out.append((kind, at, x))
            at, j = max(at, y), j + 1
            if x == b:
                break
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, cut: float = 0.5) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans (base by kind, then added by kind)."""
    scanned = scan(docs)
    weights = learn(scanned)
    own = scanned.schema["doc_id"]
    schema = StructType([own, *[StructField(f"n_{k}", LongType()) for k in KINDS], StructField("base_sha256", StringType()), StructField("spans", StringType())])

    def run(ids, bases, founds):
        out = {f.name: [] for f in schema}
        out[own.name] = ids
        for joined, found in zip(bases, founds):
            base = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in joined.split(",") if s)]
            more = added([(int(a), int(b), v) for a, b, v in (s.split(":") for s in found.split(",") if s)], base, weights, cut)
            for k in KINDS:
                out[f"n_{k}"].append(sum(s[0] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(joined.encode()).hexdigest())
            out["spans"].append(_joined(base + sorted(more)))
        return out

    return map_rows(scanned, ["doc_id", "base", "found"], run, schema, size=4096)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of spans that meet, replaced by its kind: <EMAIL>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def query(docs: DataFrame) -> DataFrame:
    return find(docs)


def stage(docs: DataFrame, cut: float = 0.5) -> DataFrame:
    """docs with every span replaced in text, and n_chars of the new text where there is such a column."""
    weights = learn(scan(docs))
    names = docs.columns
    schema = StructType([StructField(f"k{i}", f.dataType) for i, f in enumerate(docs.schema)])
    at = names.index("text")

    def run(*columns):
        new = []
        for t in columns[at]:
            base = base_spans(t) if t else []
            more = added(candidates(t), base, weights, cut) if t else []
            new.append(redact(t, base + more) if base or more else t)
        return {f"k{i}": new if i == at else x for i, x in enumerate(columns)}

    done = map_rows(docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)]), [f"k{i}" for i in range(len(names))], run, schema)
    value = lambda i, c: F.length(f"k{at}").cast(docs.schema[c].dataType) if c == "n_chars" else F.col(f"k{i}")
    return done.select(*[value(i, c).alias(c) for i, c in enumerate(names)])
