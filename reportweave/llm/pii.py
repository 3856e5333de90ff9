"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. The method adds spans of two
further kinds, secrets (keys, passwords) and local phone numbers. Wide patterns propose candidates; four labelers of three sorts
(regex, gazetteer, context) vote on each or abstain. Expectation-maximisation over the counts of vote patterns estimates
how reliable each labeler is, without labels; its posteriors train the final classifier, a naive Bayes model over
features of the span and its surroundings, which decides about each candidate.

The corpus is read twice to learn (votes, then features by posterior) and once to find. Nothing is shuffled but counts: of vote
patterns (3**4 a kind at most) and of features (a fixed list), which is also all that the driver sees.

Defined cases: a null text is empty and has no spans; repeated rows have equal results; added spans that overlap base
spans are left out, and of two added spans that overlap the secret stays; an empty table gives an empty result. Patterns are written so that the
search is linear in the text, and places are sums of lengths, added up in blocks, so that they are (nearly) linear in the matches. Accepted candidates are
held against each base span of their text.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LOCAL = "A-Za-z0-9._%+-"
# A match can only begin where a run of its first class begins, or where the match before it ended: the guards in
# front leave all results as they are and spare the search from trying every position of a long run.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # a run of digits with single separators, whole: from its first digit on, and of 16 to 19 digits. All others would fail the check.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDED = {"email": "@", "phone": "+"}
ADDED = {
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]{0,63}[0-9])[A-Za-z0-9]{12,64}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])",
}
GAZETTEER = {
    "secret": ["password", "passwd", "pwd", "passphrase", "token", "secret", "apikey", "key", "auth", "bearer", "credential"],
    "local_phone": ["phone", "tel", "telephone", "call", "mobile", "cell", "fax", "contact", "ring", "sms"],
}
CONTEXT = {"secret": r"[=:]\s*[\"']?$", "local_phone": r"(?:[:+]|\+[0-9]{1,3})\s*$"}
STRICT = {"secret": r"^(?:[0-9a-f]{16,64}|[0-9A-F]{16,64}|(?:AKIA|ghp|sk)[0-9A-Za-z]{12,60})$", "local_phone": r"^(?:\([0-9]{3}\) [0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4})$"}
DOUBT = {"secret": r"^(?:[0-9]+|[A-Za-z]+[0-9]{1,2})$", "local_phone": r"^[0-9]{3} [0-9]{3} [0-9]{4}$"}
LABELERS = 4
_SPAN = "array<struct<start:int,end:int,match:string>>"


_BLOCK = 256


def running_sum(lengths: Column) -> Column:
    """array<int> of the sums up to each element. Appending copies an array, so sums run within blocks, then over blocks."""
    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)))
    ints = F.array().cast("array<int>")
    start = F.struct(F.lit(0).alias("at"), ints.alias("out"))
    grow = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out"))
    hold = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))
    sums = F.transform(blocks, lambda b: F.aggregate(b, start, grow, lambda acc: acc["out"]))
    bases = F.aggregate(F.transform(sums, lambda s: F.element_at(s, -1)), start, hold, lambda acc: acc["out"])
    return F.when(n > 0, F.flatten(F.zip_with(sums, bases, lambda s, b: F.transform(s, lambda x: x + b)))).otherwise(ints)


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def matches(text: Column, pattern: str, before: int = 0) -> Column:
    """array<struct<start, end, match>>: leftmost matches that don't overlap, in code points, end exclusive.

    With before, also so many code points of left context at most, which the two matches before and what is between must cover.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))

    def placed(p):
        def span(x, i):
            end = F.get(p["ends"], i)
            fields = [(end - F.length(x)).alias("start"), end.alias("end"), x.alias("match")]
            if before:
                piece = lambda a, j: F.coalesce(F.get(p[a], j), F.lit(""))
                fields.append(F.right(F.concat(piece("found", i - 2), piece("between", i - 1), piece("found", i - 1), piece("between", i)), F.lit(before)).alias("before"))
            return F.struct(*fields)

        return F.transform(p["found"], span)

    def summed(p):
        ends = running_sum(F.zip_with(p["found"], p["between"], lambda f, b: F.length(f) + F.length(b)))
        return _bound(F.struct(p["found"].alias("found"), p["between"].alias("between"), ends.alias("ends")), placed)

    return _bound(F.struct(found.alias("found"), between.alias("between")), summed)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(c: Column) -> Column:
    """Whether the digits of c pass Luhn's check."""
    digit = F.transform(F.split(F.reverse(_digits(c)), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d >= "5", 9).otherwise(0)))
    return F.aggregate(digit, F.lit(0), lambda a, d: a + d) % 10 == 0


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda m: F.when(F.length(_digits(m)).between(16, 19), _luhn(m)).otherwise(F.lit(False)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    found = F.filter(matches(text, PATTERNS[kind]), lambda s: CHECKS[kind](s["match"]))
    return F.when(text.contains(NEEDED[kind]), found).otherwise(F.array().cast(_SPAN)) if kind in NEEDED else found


def candidates(text: Column, kind: str) -> Column:
    """array<struct<start, end, match, before>>: before has up to 24 code points of left context; candidates are of 12 at least."""
    return matches(text, ADDED[kind], 24)


def votes(kind: str, match: Column, before: Column) -> Column:
    """array<int> of LABELERS: 1 for, 0 against, -1 abstains. Regex, gazetteer, context, and a regex that doubts."""
    words = "|".join(GAZETTEER[kind])
    return F.array(
        F.when(match.rlike(STRICT[kind]), 1).otherwise(0),
        F.when(before.rlike(rf"(?i)(?:{words})[^A-Za-z0-9]*$"), 1).when(before.rlike(r"[A-Za-z]\s*$"), 0).otherwise(-1),
        F.when(before.rlike(CONTEXT[kind]), 1).otherwise(0),
        F.when(match.rlike(DOUBT[kind]), 0).otherwise(-1),
    )


def span_features(kind: str, match: Column, before: Column) -> Column:
    """Names of the span's features: one of each group."""
    share = F.length(F.regexp_replace(match, "[^0-9]", "")) * 4 / F.length(match)
    case = F.when(match.rlike("[a-z]") & match.rlike("[A-Z]"), "mixed").when(match.rlike("[a-z]"), "lower").when(match.rlike("[A-Z]"), "upper").otherwise("none")
    last = F.when(before == "", "start").when(before.rlike(r"[=:]\s*$"), "assign").when(before.rlike(r"[\"'(\[]$"), "open").when(before.rlike(r"[A-Za-z]\s*$"), "word").when(before.rlike(r"[0-9]\s*$"), "digit").otherwise("other")
    cue = F.when(before.rlike(rf"(?i)(?:{'|'.join(GAZETTEER[kind])})[^A-Za-z0-9]*$"), "cue").otherwise("none")
    groups = [
        ("length", F.least(F.length(match) / 8, F.lit(8)).cast("int").cast("string")),
        ("digits", share.cast("int").cast("string")),
        ("case", case),
        ("hex", match.rlike("^[0-9a-fA-F]+$").cast("string")),
        ("left", last),
        ("cue", cue),
    ]
    return F.array(*[F.concat(F.lit(f"{kind}:{name}="), value) for name, value in groups])


def reliabilities(counts: list[tuple], rounds: int = 50) -> dict:
    """EM over (kind, votes, count): {kind: {votes: probability that such a span is real}}.

    A labeler has a chance to vote for, and one to vote against, under either truth; abstaining tells nothing.
    """
    out: dict = {}
    for kind in {k for k, _, _ in counts}:
        rows = [(tuple(v), n) for k, v, n in counts if k == kind]
        prior, hit, false = 0.5, [0.8] * LABELERS, [0.2] * LABELERS
        for _ in range(rounds):
            post = {}
            for v, _n in rows:
                yes, no = math.log(prior), math.log(1 - prior)
                for j, x in enumerate(v):
                    if x >= 0:
                        yes += math.log(hit[j] if x else 1 - hit[j])
                        no += math.log(false[j] if x else 1 - false[j])
                post[v] = 1 / (1 + math.exp(min(700, no - yes)))
            total = sum(n for _, n in rows)
            real = sum(n * post[v] for v, n in rows)
            prior = min(max((real + 1) / (total + 2), 1e-4), 1 - 1e-4)
            for j in range(LABELERS):
                voted = [(v, n) for v, n in rows if v[j] >= 0]
                for chance, weigh in ((hit, lambda v: post[v]), (false, lambda v: 1 - post[v])):
                    mass = sum(n * weigh(v) for v, n in voted)
                    chance[j] = (sum(n * weigh(v) for v, n in voted if v[j] == 1) + (8 if chance is hit else 2)) / (mass + 10)
        out[kind] = post
    return out


def _entry(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), votes(kind, s["match"], s["before"]).alias("votes"), span_features(kind, s["match"], s["before"]).alias("features"))


def _proposed(docs: DataFrame) -> DataFrame:
    """(kind, votes, features) of all candidates of docs(text)."""
    each = None
    cols = {k: candidates(F.col("text"), k) for k in ADDED}
    wide = docs.select(*[c.alias(k) for k, c in cols.items()])
    for kind in ADDED:
        entry = F.transform(kind, _entry(kind))
        each = entry if each is None else F.concat(each, entry)
    return wide.select(F.explode(each).alias("x")).select("x.*")


def train(docs: DataFrame) -> dict[str, float]:
    """Weights of the final classifier by feature, and under '<kind>:' its bias."""
    text = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = _proposed(text).groupBy("kind", "votes", "features").count()
    # patterns and features are of fixed lists: the table of their counts is bounded whatever the corpus
    rows = counts.collect()
    by_votes: dict = {}
    for r in rows:
        by_votes[r["kind"], tuple(r["votes"])] = by_votes.get((r["kind"], tuple(r["votes"])), 0) + r["count"]
    post = reliabilities([(k, v, n) for (k, v), n in by_votes.items()])
    real: dict = {}
    total: dict = {}
    for r in rows:
        p = post[r["kind"]][tuple(r["votes"])]
        for f in [*r["features"], f"{r['kind']}:"]:
            real[f] = real.get(f, 0.0) + p * r["count"]
            total[f] = total.get(f, 0.0) + r["count"]
    weights = {}
    for f in sorted(total):
        kind = f.partition(":")[0]
        yes, no = real[f"{kind}:"], total[f"{kind}:"] - real[f"{kind}:"]
        if f == f"{kind}:":
            weights[f] = math.log((yes + 1) / (no + 1))
        else:
            weights[f] = math.log((real[f] + 0.5) / (yes + 1)) - math.log((total[f] - real[f] + 0.5) / (no + 1))
    return weights


def added_spans(text: Column, kind: str, weights: dict[str, float], base: Column) -> Column:
    """Candidates that the classifier accepts and that overlap none of the spans in base."""
    table = F.create_map(*[F.lit(x) for f, w in weights.items() for x in (f, w)]) if weights else None
    none = F.array().cast(_SPAN)
    if table is None or f"{kind}:" not in weights:
        return none

    def real(s):
        score = F.aggregate(span_features(kind, s["match"], s["before"]), F.lit(float(weights[f"{kind}:"])), lambda a, f: a + F.coalesce(F.try_element_at(table, f), F.lit(0.0)))
        return (score > 0) & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    return F.transform(F.filter(candidates(text, kind), real), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match")))


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, then an array<struct<start, end, match>> column for each base and added kind."""
    return _with_spans(docs, weights).drop("text")


def _with_spans(docs: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    weights = train(docs) if weights is None else weights
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", *[base_spans(F.col("text"), k).alias(k) for k in PATTERNS])
    for i, kind in enumerate(ADDED):
        taken = F.concat(*PATTERNS, *list(ADDED)[:i])
        rows = rows.withColumn(kind, added_spans(F.col("text"), kind, weights, taken))
    return rows


def spelled(kinds: list[str]) -> Column:
    """kind:start:end of the columns' spans, comma-joined."""
    spell = lambda k: lambda s: F.concat_ws(":", F.lit(k), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.concat(*[F.transform(k, spell(k)) for k in kinds]), ",")


def mask_pii(docs: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, text) with every span replaced by its kind in angle brackets. Finding is native; texts are put together in one pass over their spans."""
    named = lambda k: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(k).alias("kind"))
    spans = F.array_sort(F.concat(*[F.transform(k, named(k)) for k in [*PATTERNS, *ADDED]]))
    found = _with_spans(docs, weights).select("doc_id", "text", spans.alias("spans"))

    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                at, parts = 0, []
                for s in spans:
                    if s["start"] >= at:
                        parts += [text[at : s["start"]], f"<{s['kind']}>"]
                    at = max(at, s["end"])
                out.append("".join([*parts, text[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return found.mapInArrow(run, f"doc_id {dict(found.dtypes)['doc_id']}, text string")
