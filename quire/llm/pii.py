"""Personal data by weak supervision, with DataFrame functions only.

*Base spans* come from four patterns (email, ip, card, phone), leftmost and not
overlapping within a kind; a match that fails its test is dropped, without a retry.

*Added spans* (secret, person, number) come from wide candidate patterns. Labelers vote on
every candidate for (1), against (-1) or not at all (0): regex labelers look at its shape,
gazetteer labelers at its words, context labelers at what stands before it.
Expectation-maximisation over the counts of the vote patterns - at most 3^labelers a kind,
all the driver gets to see - estimates how the labelers vote on true and false candidates;
the posteriors then are the soft labels with which a naive Bayes classifier over features
of the span and its surroundings is trained, again from bounded counts over all
candidates. It decides which candidates are added. An added span that overlaps a base
span, or one added before it, is left out.

Nothing is shuffled but counts. A match's offset is the sum of the lengths of what the
pattern splits off before it and of earlier matches, in code points.

Defined results: null counts as empty and has no spans; empty tables give empty results;
repeated rows repeated ones. Where no candidate exists nothing is added.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> (cheap test that a match needs, pattern). Possessive forms of the given patterns: the
#: same matches, without backtracking; starts within a run that has failed are skipped. Classes
#: are written with as few ranges as can be, since each is a predicate of its own in Java's matcher.
BASE = {
    "email": ("@", r"(?:\G|(?<![\w.%+-]))[\w.%+-]++@[\p{Alnum}-]++(?:\.[\p{Alnum}-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9]){11,}+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = [*BASE, "secret", "person", "number"]

#: Candidates of added kinds.
CANDIDATES = {
    "secret": r"(?<![\w/+.@-])(?=[\p{Alpha}_/+-]*[0-9])[\w/+-]{12,}+(?![@.])",
    "person": r"(?<![\p{L}\p{N}])\p{Lu}\p{Ll}{2,}+(?:\x20\p{Lu}\p{Ll}{2,}+){1,2}+(?![\p{L}\p{N}])",
    "number": r"(?<![0-9A-Za-z+.-])[0-9]{3}[-.\x20][0-9]{2,4}[-.\x20][0-9]{4}(?![0-9A-Za-z-])",
}
_NAMES = "james|john|robert|michael|william|david|richard|joseph|thomas|charles|mary|patricia|jennifer|linda|elizabeth|barbara|susan|jessica|sarah|karen|anna|maria|peter|paul|hans|klaus|jean|pierre|marie|luis|carlos|jose|juan|ana|carmen|emma|sophie|laura"
_SECRET = r"(?i)(?:password|passwd|pwd|secret|api[_ -]?key|access[_ -]?key|token|bearer|credential)s?[\x20\"']*[=:]?[\x20\"']*\z"
_PERSON = r"(?i)(?:\b(?:mr|mrs|ms|dr|prof|herr|frau|mme|monsieur|señor|señora)\.?|name is|named|contact|signed|written by|author:?|name:)[\x20]*\z"
_NUMBER = r"(?i)(?:ssn|social security(?: number| no\.?)?|phone|tel|call|fax|mobile|cell|passport|account)[\x20.:#]*\z"

#: kind -> labelers; each gives a vote from the candidate's text (t) and what stands before it (b).
LABELERS = {
    "secret": {
        "regex_hex": lambda t, b: F.when(t.rlike(r"^[0-9a-f]{16,}\z"), 1).when(t.rlike(r"^[A-Z][a-z]+[0-9]{1,4}\z"), -1).otherwise(0),
        "regex_mix": lambda t, b: F.when((F.length(t) >= 16) & t.rlike("[a-zA-Z].*[0-9].*[a-zA-Z]"), 1).when(t.rlike(r"^[0-9-]+\z"), -1).otherwise(0),
        "gazetteer": lambda t, b: F.when(F.lower(t).rlike(r"http|www|covid|version|chapter|section|figure"), -1).when(t.rlike(r"^(?:AKIA|ghp_|sk-|xox)"), 1).otherwise(0),
        "context": lambda t, b: F.when(b.rlike(_SECRET), 1).when(b.rlike(r"\p{L}[\x20,;]*\z"), -1).otherwise(0),
    },
    "person": {
        "regex_three": lambda t, b: F.when(t.rlike(r"^\S+ \S+ \S+\z"), -1).otherwise(0),
        "gazetteer": lambda t, b: F.when(F.lower(t).rlike(rf"^(?:{_NAMES})\x20"), 1).otherwise(-1),
        "gazetteer_other": lambda t, b: F.when(F.lower(t).rlike(r"\b(?:the|and|license|public|general|university|street|north|south|united|new)\b"), -1).otherwise(0),
        "context": lambda t, b: F.when(b.rlike(_PERSON), 1).when(b.rlike(r"(?:\A|[.!?]\s*)\z"), -1).otherwise(0),
    },
    "number": {
        "regex_ssn": lambda t, b: F.when(t.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}\z"), 1).otherwise(0),
        "regex_even": lambda t, b: F.when(t.rlike(r"^[0-9]{3}([-.\x20])[0-9]{3}\1[0-9]{4}\z"), 1).otherwise(-1),
        "gazetteer": lambda t, b: F.when(t.rlike(r"^(?:000|666)"), -1).otherwise(0),
        "context": lambda t, b: F.when(b.rlike(_NUMBER), 1).when(b.rlike(r"[0-9$€=]\s*\z"), -1).otherwise(0),
    },
}

#: Features of the final classifier, each with few values.
FEATURES = {
    "length": lambda t, b: F.least(F.floor(F.log2(F.length(t))), F.lit(8)).cast("string"),
    "shape": lambda t, b: F.when(t.rlike(r"^[0-9a-f]+\z"), "hex").when(t.rlike(r"^[0-9\p{P}\x20]+\z"), "digits").when(t.rlike(r"^[A-Z0-9_]+\z"), "upper").when(t.rlike(r"[0-9]"), "mixed").otherwise("letters"),
    "before": lambda t, b: F.when(F.length(b) == 0, "start").when(b.rlike(r"[=:\"'][\x20]*\z"), "assigned").when(b.rlike(r"[.!?]\s*\z"), "sentence").when(b.rlike(r"\p{L}\s*\z"), "word").otherwise("other"),
    "keyword": lambda t, b: F.when(b.rlike(_SECRET), "secret").when(b.rlike(_PERSON), "person").when(b.rlike(_NUMBER), "number").otherwise("none"),
    "first": lambda t, b: F.when(F.lower(t).rlike(rf"^(?:{_NAMES})\x20"), "name").when(t.rlike(r"^[0-9]"), "digit").otherwise("other"),
}

_SPAN = "struct<start:int,end:int,text:string,before:string>"


# ---------------------------------------------------------------- spans


def _spans(found: Column, parts: Column) -> Column:
    """Matches with offsets, from what a pattern extracts and what it splits off."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["parts"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["found"].alias("text"), F.substring(x["parts"], -48, 48).alias("before"))
        return F.when(x["found"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out")))

    zipped = F.arrays_zip(found.alias("found"), parts.alias("parts"))
    return F.aggregate(zipped, start, add, lambda acc: acc["out"])


def _with_spans(rows: DataFrame, name: str, test: str, pattern: str) -> DataFrame:
    """rows (text, ...) with a column of spans of a pattern; texts that fail the cheap test aren't searched."""
    may = F.col("text").rlike(test)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("found", F.when(may, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
    rows = rows.withColumn("parts", F.when(F.size("found") > 0, F.split("text", pattern, -1)).otherwise(none))
    return rows.withColumn(name, F.when(F.size("found") > 0, _spans(F.col("found"), F.col("parts"))).otherwise(F.array().cast(f"array<{_SPAN}>"))).drop("found", "parts")


def _digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    ordered = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = d.try_cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    return F.aggregate(F.transform(F.filter(ordered, lambda d: d != ""), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _octet(part: Column) -> Column:
    return F.coalesce(F.regexp_replace(part, r"^0+(?=[0-9])", "").try_cast("decimal(38,0)") <= 255, F.lit(False))


TESTS = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: F.forall(F.split(t, r"\."), _octet),
    "card": lambda t: F.length(_digits(t)).between(12, 19) & luhn(_digits(t)),
    "phone": lambda t: F.length(_digits(t)).between(9, 15),
}


def _filtered(kind: str) -> Column:
    return F.filter(kind, lambda s: TESTS[kind](s["text"]))


def base_spans(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text) with an array of spans for each base kind."""
    for kind, (test, pattern) in BASE.items():
        rows = _with_spans(rows, kind, test, pattern)
        if kind != "email":
            rows = rows.withColumn(kind, _filtered(kind))
    return rows


def candidates(rows: DataFrame) -> DataFrame:
    """rows with an array of candidate spans for each added kind."""
    for kind, pattern in CANDIDATES.items():
        rows = _with_spans(rows, kind, pattern, pattern)
    return rows


# ---------------------------------------------------------------- weak supervision


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 60) -> dict[tuple[int, ...], float]:
    """Posterior of each vote pattern, by EM over the patterns' counts.

    A labeler's votes on true and on false candidates are two distributions over (1, 0, -1),
    begun as those of a labeler that is right four times out of five when it votes.
    """
    if not patterns:
        return {}
    labelers = len(next(iter(patterns)))
    given = [[{1: 0.4, 0: 0.5, -1: 0.1} for _ in range(labelers)], [{1: 0.1, 0: 0.5, -1: 0.4} for _ in range(labelers)]]
    prior, posterior = 0.3, {}
    for _ in range(rounds):
        for votes in patterns:
            true = math.log(prior) + sum(math.log(given[0][j][v]) for j, v in enumerate(votes))
            false = math.log(1 - prior) + sum(math.log(given[1][j][v]) for j, v in enumerate(votes))
            posterior[votes] = 1 / (1 + math.exp(max(-700.0, min(700.0, false - true))))
        mass = [sum(n * posterior[v] for v, n in patterns.items()), sum(n * (1 - posterior[v]) for v, n in patterns.items())]
        prior = (mass[0] + 1) / (mass[0] + mass[1] + 2)
        for side in (0, 1):
            for j in range(labelers):
                begun = (0.4, 0.5, 0.1) if side == 0 else (0.1, 0.5, 0.4)
                for v, pseudo in zip((1, 0, -1), begun, strict=True):
                    hit = sum(n * (posterior[x] if side == 0 else 1 - posterior[x]) for x, n in patterns.items() if x[j] == v)
                    given[side][j][v] = (hit + 10 * pseudo) / (mass[side] + 10)
    return posterior


def _lookup(key: Column, table: dict[str, float], default: float) -> Column:
    """Value of a key in a small table, as a map literal."""
    if not table:
        return F.lit(default)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(default))


def _votes(kind: str, t: Column, b: Column) -> Column:
    return F.concat_ws(",", *(vote(t, b).cast("string") for vote in LABELERS[kind].values()))


def train(rows: DataFrame) -> dict[str, tuple[float, dict[str, dict[str, float]]]]:
    """kind -> (bias, feature -> value -> weight) of the final classifier, from the candidates of all rows (text)."""
    found = candidates(rows)
    parts = []
    for kind in CANDIDATES:
        t, b = F.col("s.text"), F.col("s.before")
        one = found.select(F.explode_outer(kind).alias("s")).filter("s is not null")  # no filter on the array's size, which would be pushed below and search twice
        parts.append(one.select(F.lit(kind).alias("kind"), _votes(kind, t, b).alias("votes"), F.concat_ws("|", *(f(t, b) for f in FEATURES.values())).alias("features")))
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    counts = every.groupBy("kind", "votes", "features").count().collect()  # labelers and features have few values each
    model = {}
    for kind in CANDIDATES:
        own = [(tuple(map(int, r["votes"].split(","))), r["features"].split("|"), r["count"]) for r in counts if r["kind"] == kind]
        patterns: dict[tuple[int, ...], int] = {}
        for votes, _, n in own:
            patterns[votes] = patterns.get(votes, 0) + n
        posterior = estimate(patterns)
        mass = [sum(n * posterior[v] for v, _, n in own) + 1, sum(n * (1 - posterior[v]) for v, _, n in own) + 1]
        weights: dict[str, dict[str, float]] = {}
        for k, name in enumerate(FEATURES):
            values = {f[k] for _, f, _ in own}
            weights[name] = {}
            for value in values:
                true = sum(n * posterior[v] for v, f, n in own if f[k] == value) + 0.5
                false = sum(n * (1 - posterior[v]) for v, f, n in own if f[k] == value) + 0.5
                weights[name][value] = math.log(true / (mass[0] + 0.5 * len(values))) - math.log(false / (mass[1] + 0.5 * len(values)))
        model[kind] = (math.log(mass[0] / mass[1]), weights)
    return model


def classified(spans: Column, model: tuple[float, dict[str, dict[str, float]]]) -> Column:
    """The candidate spans that the classifier takes."""
    bias, weights = model

    def taken(s: Column) -> Column:
        score = F.lit(bias)
        for name, feature in FEATURES.items():
            score = score + _lookup(feature(s["text"], s["before"]), weights[name], 0.0)
        return score >= 0

    return F.filter(spans, taken)


# ---------------------------------------------------------------- results


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (start, rank, end, kind, text), in order of start and kind."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = train(rows.select("text"))
    rows = candidates(base_spans(rows))

    def tagged(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["text"].alias("text")))

    rows = rows.withColumn("base", F.array_sort(F.concat(*(tagged(k, F.col(k)) for k in BASE))))
    rows = rows.withColumn("added", F.concat(*(tagged(k, classified(F.col(k), model[k])) for k in CANDIDATES)))
    free = lambda s, others: ~F.exists(others, lambda o: (o["start"] < s["end"]) & (s["start"] < o["end"]) & ((o["start"] != s["start"]) | (o["rank"] != s["rank"])) & ((o["rank"] < len(BASE)) | (o["start"] < s["start"]) | ((o["start"] == s["start"]) & (o["rank"] < s["rank"]))))
    rows = rows.withColumn("every", F.concat("base", "added"))
    rows = rows.withColumn("added", F.when(F.size("added") > 0, F.array_sort(F.filter("added", lambda s: free(s, F.col("every"))))).otherwise(F.col("added")))
    return rows.select("doc_id", "base", "added")


def _equal(kind: str):
    return lambda k: k == kind


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter(F.col("base.kind"), _equal(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "added"))).alias("spans"))
