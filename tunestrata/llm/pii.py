"""Personal data by weak supervision.

Fixed forms (e-mail, IP address, payment card, international phone number) are always spans.
Looser forms are candidates: masked e-mails, account numbers, local phone numbers, long numbers,
personal names and street addresses. Several labelers vote on each, or abstain: a regular form's own
check, a gazetteer of known parts, words that stand before it, and words that speak against it.
Expectation-maximisation over the counts of vote patterns tells, for each kind by itself, how far
each labeler can be trusted there; its posteriors teach a classifier on the candidates' features,
which alone decides on what becomes a span.

Votes and features are few and discrete, so all that is learnt from is a count per combination:
a table whose size does not depend on the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from tunestrata.llm.common import text_or_empty, written

BASE = ("email", "ip", "card", "phone")
LOOSE = ("masked_email", "account", "local_phone", "long_number", "address", "person")  # earlier ones take their place first
KINDS = BASE + LOOSE
#: A candidate becomes a span at this probability.
SURE = 0.9
#: The classifier's pull to zero, in candidates: with few of them it is sure of none.
PULL = 0.3

# The base patterns. Possessive and look-behind forms match the same text as the
# plain ones (what follows a run of digits is never a digit) but in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT, _MASK = re.compile(r"[0-9]"), re.compile(r"[\[({](?:at|AT)[\])}]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

_NAME = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]{1,20}"
_LOOSE = {
    "masked_email": re.compile(r"\b[A-Za-z0-9._-]{1,64} ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]{1,63} ?[\[({](?:dot|DOT)[\])}] ?[A-Za-z]{2,12}\b"),
    "account": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "local_phone": re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\) ?|0[0-9]{1,4}[ /-])[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![0-9.-])"),
    "long_number": re.compile(r"(?<![0-9.,+-])[0-9]{3,6}(?:[ -][0-9]{2,6}){2,4}(?![0-9.,-])"),
    "address": re.compile(
        rf"\b[0-9]{{1,5}}[a-z]?,? (?:{_NAME} ){{1,3}}(?:[Ss]treet|[Ss]t|[Rr]oad|[Rr]d|[Aa]venue|[Aa]ve|[Ll]ane|[Dd]rive|[Ss]quare)\b"
        rf"|\b[0-9]{{1,4}},? (?:rue|avenue|boulevard|place|chemin) (?:d[eu]s? |la |l')?{_NAME}"
        rf"|\b(?:[Cc]alle|[Aa]venida|[Pp]laza|[Pp]aseo) (?:del? |la )?{_NAME},? [0-9]{{1,4}}\b"
        r"|\b[A-ZÄÖÜ][a-zäöüß]{2,20}(?:straße|strasse|weg|platz|gasse|allee) [0-9]{1,4}[a-z]?\b"
    ),
    "person": re.compile(rf"(?<!\w)(?!(?:Dear|Mrs?|Ms|Dr|Prof|Herr|Frau|Se[ñn]ora?|Monsieur|Madame|Contact|Signed|Name)\b){_NAME}(?: {_NAME}){{1,2}}(?!\w)"),
}

# Known parts and words, for the labelers.
#: Length of an account number (IBAN) by country.
_IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18,
    "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21,
    "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
_TOP_DOMAINS = frozenset(
    "com org net edu gov io info biz dev app eu de at ch fr be nl lu es pt it gr pl cz sk hu ro bg hr si dk se no fi is ie uk us ca mx br ar cl co au nz jp kr cn in za".split()
)
_GIVEN_NAMES = frozenset(
    """adam alice amy andrea andrew anna anne antonio barbara ben bernd brian carlos carmen catherine charles charlotte chris christian
    christine claire claude claudia daniel david diana diego dieter elena elizabeth emily emma eric eva felix fernando francois frank franz
    gabriel george gerard grace greta hans heinz helen henry ines isabel jack jacques james jan jane jean jennifer joan john jonas jose
    joseph juan julia julie karen karl katharina kevin klaus laura lena leon linda lisa louis lucas lucia luis manuel marc maria marie mark
    martin mary matthew max michael michel miguel monika nadia nicolas nina olivia pablo patricia paul pedro peter petra philippe pierre
    rachel richard robert rosa ruth sabine sam sandra sara sarah simon sofia sophie stefan stephen susan teresa thomas tim tom ursula
    victor werner william wolfgang""".split()
)
#: Words that follow a number in a street, or stand in names of streets; and words names do not begin with.
_STREET_PARTS = frozenset("main high park church mill north south east west hill lake oak elm king queen station haupt bahnhof garten schul kirch république gare mayor".split())
_NOT_NAMES = frozenset("the this that these those a an in on at of and or but for from to if when as is it he she we you they der die das ein eine und le la les un une et el los las una y united new north south east west january february march april may june july august september october november december monday tuesday wednesday thursday friday saturday sunday".split())
_NOT_LOCAL = frozenset("look looking aim arrive point meet good bad here there mean only not at in on".split())
_NUMBER_CUES = r"contact|tel|phone|call|fax|mobile|handy|teléfono|téléphone|iban|account|konto|compte|cuenta|card|karte|carte|tarjeta|ssn|passport"
_CUES = {
    "masked_email": re.compile(r"(?:e-?mail|contact|reach|write to|mailto|correo|courriel|me at)\W*(?:\w+\W+){0,2}$", re.IGNORECASE),
    "address": re.compile(r"(?:address|live[sd]? (?:at|in)|reside[sd]?|moved to|ship(?:ped)? to|adresse|anschrift|wohnt?(?: in)?|habite|domicilio|vive en)\W*(?:\w+\W+){0,2}$", re.IGNORECASE),
    "person": re.compile(r"(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|señora?|sr|sra|monsieur|madame|mme)\.? ?|(?:name is|name:|named|contact|signed|regards|sincerely|dear|heiße|ich bin|je m'appelle|me llamo|patient|customer)\W*)$", re.IGNORECASE),
}
_DEFAULT_CUES = re.compile(rf"(?:{_NUMBER_CUES})\W*(?:\w+\W+){{0,2}}$", re.IGNORECASE)
_AGAINST = {
    "person": re.compile(r"(?:\b(?:in|near|at|the|via|university of|city of|river|mount|battle of|by train to)|[#@/])\s*$", re.IGNORECASE),
    "address": re.compile(r"(?:chapter|page|figure|table|version|seite|at least|over|about)\W*$", re.IGNORECASE),
}
_DEFAULT_AGAINST = re.compile(r"(?:isbn|issn|doi|version|page|seite|figure|table|chapter|order|item|part|line|row|id|no\.|nr\.|[#$€£%=])\W*(?:\w+\W+)?$", re.IGNORECASE)


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``local@domain``, found from the @ backwards in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, stop)`` of the fixed forms, by kind, then start."""
    spans = [(0, *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                spans.append((1, *m.span()))
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append((2, *m.span()))
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((3, *m.span()))
    return spans


def _iban(form: str) -> bool:
    plain = form.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _form_and_list(name: str, found: str) -> tuple[int, int]:
    """What a candidate's own form and its kind's gazetteer say of it."""
    digits = _NOT_DIGIT.sub("", found)
    if name == "masked_email":
        local, *_, top = re.split(r"[^A-Za-z0-9._-]+", found.lower())
        plain = local.strip("._-")
        form = -1 if plain in _NOT_LOCAL else 1 if "." in plain or any(c.isdigit() for c in plain) else 0
        return form, 1 if top in _TOP_DOMAINS else -1
    if name == "account":
        length = len(found.replace(" ", ""))
        return (1 if _iban(found) else -1), (1 if _IBAN_LENGTHS.get(found[:2]) == length else -1)
    if name == "address":
        words = re.findall(r"[^\W\d]+", found.lower())
        street = any(w in _STREET_PARTS or any(w.startswith(p) for p in ("haupt", "bahnhof", "schul", "kirch", "garten")) for w in words)
        return (1 if 1 <= int(digits or 0) <= 999 else -1), (1 if street else 0)
    if name == "person":
        words = found.lower().split()
        shape = -1 if words[0] in _NOT_NAMES or len(set(words)) < len(words) else 1 if len(words) == 2 and min(map(len, words)) > 2 else 0
        return shape, 1 if words[0] in _GIVEN_NAMES else 0
    listed = -1 if len(set(digits)) <= 2 or digits in "01234567890123456789" else 0
    if name == "long_number":
        return (1 if len(digits) in (9, 13, 14, 15, 16) and len(re.findall("[ -]", found)) >= 2 else -1), listed
    return (1 if 9 <= len(digits) <= 12 else -1), listed


def _votes(kind: int, found: str, before: str) -> tuple[int, int, int, int]:
    """Votes of the form, list, context and counter-context labelers: 1 for, -1 against, 0 none."""
    name = KINDS[kind]
    cue, against = _CUES.get(name, _DEFAULT_CUES).search(before), _AGAINST.get(name, _DEFAULT_AGAINST).search(before)
    return *_form_and_list(name, found), 1 if cue else 0, -1 if against else 0


def _code(kind: int, votes: tuple[int, ...], found: str, before: str) -> int:
    """Kind, votes and shape (separators, length, whether it begins a line) as one number."""
    code = kind
    for vote in votes:
        code = code * 3 + vote + 1
    separators, length = min(len(re.findall(r"[ -]", found)), 2), min(len(found) // 8, 3)
    return ((code * 3 + separators) * 4 + length) * 2 + (before.rpartition("\n")[2].strip() == "")


def _features(code: int) -> tuple[int, tuple[int, ...], tuple[int, int, int]]:
    code, opens = divmod(code, 2)
    code, length = divmod(code, 4)
    code, separators = divmod(code, 3)
    votes = []
    for _ in range(4):
        code, vote = divmod(code, 3)
        votes.append(vote - 1)
    return code, tuple(reversed(votes)), (separators, length, opens)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """``(kind, start, stop, code)`` of the loose forms that touch no base span."""
    found = []
    digits, masked = bool(_DIGIT.search(text)), bool(_MASK.search(text))
    held = sorted((a, b) for _, a, b in taken)
    for name, pattern in _LOOSE.items():
        if not (masked if name == "masked_email" else digits or name == "person"):
            continue
        kind, i, fresh = KINDS.index(name), 0, []
        for m in pattern.finditer(text):
            a, b = m.span()
            while i < len(held) and held[i][1] <= a:
                i += 1
            if i < len(held) and held[i][0] < b:
                continue
            before = text[max(0, a - 40) : a]
            fresh.append((kind, a, b, _code(kind, _votes(kind, m[0], before), m[0], before)))
        found += fresh
        held = sorted(held + [(a, b) for _, a, b, _ in fresh])
    return found


_BASE_TYPE = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", LongType()), StructField("stop", LongType())]))
_LOOSE_TYPE = ArrayType(
    StructType([StructField(n, LongType() if n in ("start", "stop") else IntegerType()) for n in ("kind", "start", "stop", "code")])
)


@F.pandas_udf(StructType([StructField("base", _BASE_TYPE), StructField("loose", _LOOSE_TYPE)]))
def _looked(texts: pd.Series) -> pd.DataFrame:
    base = [base_spans(t) for t in texts]
    loose = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
    names = ("kind", "start", "stop", "code")
    rows = [[dict(zip(names, s, strict=False)) for s in spans] for spans in (*base, *loose)]
    return pd.DataFrame({"base": rows[: len(base)], "loose": rows[len(base) :]})


_VOTE_PRIOR = np.array([[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]])


def not_worse_than_chance(rows: np.ndarray) -> np.ndarray:
    """Shares of the votes -1, 0, 1 by class, where a vote for is no rarer and a vote against no more
    frequent among what is personal data; otherwise it says nothing and both classes share its rate."""
    shares, pooled = rows / rows.sum(axis=1, keepdims=True), rows.sum(axis=0) / rows.sum()
    if shares[1, 0] > shares[0, 0]:
        shares[:, 0] = pooled[0]
    if shares[1, 2] < shares[0, 2]:
        shares[:, 2] = pooled[2]
    shares[:, 1] = 1 - shares[:, 0] - shares[:, 2]
    return np.maximum(shares, 1e-9)


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = 100) -> tuple[dict[tuple[int, ...], float], np.ndarray]:
    """Posterior of each vote pattern, and ``[labeler, class, vote + 1]`` probabilities, by EM.

    Starts from the balance of votes. Dirichlet smoothing keeps a labeler that never votes, or a
    corpus without candidates, from dividing by nothing, and few candidates teach little. No labeler
    may come out worse than chance, which fixes the meaning of the two classes.
    """
    patterns = sorted(counts)
    votes = np.array(patterns, np.int64).reshape(len(patterns), -1)
    n = np.array([counts[p] for p in patterns])
    total = votes.sum(axis=1)
    posterior = np.where(total > 0, 0.9, np.where(total < 0, 0.1, 0.3))
    table = np.full((votes.shape[1], 2, 3), 1 / 3)
    for _ in range(rounds):
        share = np.array([(n * (1 - posterior)).sum() + 1, (n * posterior).sum() + 1])
        share /= share.sum()
        for j in range(votes.shape[1]):
            rows = np.array([[weight[votes[:, j] == v].sum() for v in (-1, 0, 1)] for weight in (n * (1 - posterior), n * posterior)])
            table[j] = not_worse_than_chance(rows + _VOTE_PRIOR)
        logs = np.log(share)[None, :] + sum(np.log(table[j][:, votes[:, j] + 1]).T for j in range(votes.shape[1]))
        fresh = 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))
        if len(patterns) == 0 or np.abs(fresh - posterior).max() < 1e-9:
            posterior = fresh
            break
        posterior = fresh
    return dict(zip(patterns, posterior.tolist(), strict=True)), table


def _design(code: int) -> list[float]:
    """A candidate's features: kind, each vote by kind, and its shape."""
    kind, votes, (separators, length, opens) = _features(code)
    own = [float(kind == k) for k in range(len(BASE), len(KINDS))]
    by_kind = [here * (v == s) for here in own for v in votes for s in (-1, 1)]
    shape = [float(separators == s) for s in (1, 2)] + [float(length == s) for s in (1, 2, 3)] + [float(opens)]
    return [1.0, *own, *by_kind, *(float(v == s) for v in votes for s in (-1, 1)), *shape]


def posteriors(counts: dict[int, int]) -> dict[int, float]:
    """For each feature code how likely it is personal data: EM over the vote patterns of its kind."""
    by_kind: dict[int, dict[tuple[int, ...], float]] = {}
    for code, n in counts.items():
        kind, votes, _ = _features(code)
        patterns = by_kind.setdefault(kind, {})
        patterns[votes] = patterns.get(votes, 0.0) + n
    found = {kind: reliabilities(patterns)[0] for kind, patterns in by_kind.items()}
    return {code: found[_features(code)[0]][_features(code)[1]] for code in counts}


def accepted_codes(counts: dict[int, int], sure: float = SURE) -> list[int]:
    """Feature codes whose candidates become spans: EM over votes, then a logistic span classifier, fitted
    to the posteriors by Newton's method with a pull to zero; it alone decides."""
    if not counts:
        return []
    posterior = posteriors(counts)
    codes = sorted(counts)
    x = np.array([_design(c) for c in codes])
    y = np.array([posterior[c] for c in codes])
    weight = np.array([counts[c] for c in codes], float)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - PULL * w
        curvature = (x * (weight * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(w))
        step = np.linalg.solve(curvature, slope)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return [c for c, prob in zip(codes, p, strict=True) if prob >= sure]


def with_spans(docs: DataFrame, sure: float = SURE, keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` and ``spans``: arrays of ``kind, start, stop`` by kind and start. Stored once,
    beside the columns to ``keep`` (all by default).

    Every whole text is read once; what is learnt comes from counts of the stored candidates.
    """
    kept = docs.columns if keep is None else keep
    looked = written(docs.select(*kept, _looked(text_or_empty()).alias("_looked")), "pii-candidates")
    codes = looked.select(F.explode("_looked.loose.code").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    accepted = accepted_codes({r["code"]: r["n"] for r in codes.collect()}, sure)
    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))
    loose = F.transform(F.filter("_looked.loose", lambda s: s["code"].isin(accepted)), plain)
    spans = F.array_sort(F.concat(F.col("_looked.base"), loose))
    return looked.withColumn("spans", spans).withColumn("base", F.col("_looked.base")).drop("_looked")


def _joined(spans: str) -> F.Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def personal_data(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``docs``.

    A null text counts as empty and has no span. Rows without an id and repeated rows stay; other
    columns are ignored. An empty table gives an empty result.
    """
    found = with_spans(docs, sure, keep=["doc_id"])
    counts = (F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint) as n_{n}") for k, n in enumerate(BASE))
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def redacted(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """``docs`` with every span replaced by its kind, e.g. ``<EMAIL>``; ``n_chars`` follows the text.

    Spans that overlap are replaced together, under the kind of the first. All columns keep their
    names and order; null texts stay null.
    """

    @F.pandas_udf(StringType())
    def replace(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for text, found in zip(texts, spans, strict=True):
            parts, at = [], 0
            for s in sorted(found, key=lambda s: (s["start"], -s["stop"])):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], f"<{KINDS[s['kind']].upper()}>"]
                at = max(at, s["stop"])
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    aside = {c: f"_of_docs_{c}" for c in ("base", "spans", "_looked")}
    found = with_spans(docs.withColumnsRenamed(aside), sure)
    text = F.when(F.size("spans") == 0, F.col("text")).otherwise(replace(text_or_empty(), "spans"))
    changed = found.withColumn("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.when(F.size("spans") == 0, F.col("n_chars")).otherwise(F.length("text").cast("bigint")))
    return changed.drop("base", "spans").withColumnsRenamed({v: k for k, v in aside.items()}).select(*docs.columns)
