"""Secret scan in DataFrame functions only: base patterns and character Markov models.

Base patterns (kinds assign, access, hex) are found leftmost and non-overlapping;
their places follow from the lengths of the pieces between the matches. Other long
runs of identifier characters are scored by two first-order Markov models over
characters: one of random strings, one of ordinary identifiers. A run whose
log-likelihood ratio beats the prior odds is a span of kind ``markov``. Where base
spans cover a run in part, the long parts between them are scored, each by itself.

The models are trained from labelled samples: values of the base patterns in all
documents, against the shorter identifier runs of a bounded sample of documents and
neighbouring words of a smaller one joined as identifiers and paths are written.
Only transition counts (63 x 63 for each label) reach the driver.

Defined cases: null text counts as empty; a corpus without any secret leaves the
random model uniform; repeated rows are scanned each; empty tables and extra columns are fine.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .columns import let, sums_before

# The base patterns. `hex` and `access` carry their minimum length.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "markov"]
ASSIGN_VALUE = 12                     # shortest value that counts
RUN = r"[A-Za-z0-9+/_=-]{12,}"        # candidates of the Markov models
SHORTEST = 12
IDENTIFIER = r"[A-Za-z0-9+/_=-]{4,}"  # trains the model of ordinary identifiers, if shorter than
LONG = 20                             # a long candidate
LOG_PRIOR = math.log(1e-6)            # prior odds of a long candidate; shorter ones are commoner words,
STEP = math.log(10) / 4               # so every character below LONG lowers the odds by this much

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
STATES = len(ALPHABET) + 1            # the last state is any other character


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _spans(kind: str, pattern: str, shortest: int = 0) -> Column:
    """array<struct<start, kind, end>> of a pattern's matches, places in code points."""
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")

    def found(parts: Column) -> Column:
        gaps, matches, values = parts["gaps"], parts["matches"], parts["values"]
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches,
                           lambda g, m: (F.char_length(g) + F.char_length(m)).cast("long"))
        return let(sums_before(steps), lambda before: F.filter(F.transform(matches, lambda m, k: let(
            F.get(before, k) + F.char_length(F.get(gaps, k)), lambda at: F.struct(
                at.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                (at + F.char_length(m)).cast("long").alias("end"), F.get(values, k).alias("value")))),
            lambda s: F.char_length(s["value"]) >= shortest))

    parts = F.struct(F.split(_text(), pattern, -1).alias("gaps"),
                     F.regexp_extract_all(_text(), F.lit(pattern), F.lit(0)).alias("matches"),
                     F.regexp_extract_all(_text(), F.lit(pattern), F.lit(2 if kind == "assign" else 0)).alias("values"))
    return F.when(_text().rlike(pattern), let(parts, found)).otherwise(none)


def _transitions(token: Column) -> Column:
    """State pairs (from * STATES + to) along a token."""
    states = F.transform(F.filter(F.split(token, ""), lambda c: c != ""),
                         lambda c: let(F.instr(F.lit(ALPHABET), c), lambda i: F.when(i == 0, STATES).otherwise(i) - 1))
    return let(states, lambda s: F.zip_with(F.slice(s, F.lit(1), F.greatest(F.size(s) - 1, F.lit(0))),
                                            F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))),
                                            lambda a, b: a * STATES + b))


def _styled(words: Column) -> Column:
    """Neighbouring words joined the ways identifiers, file names and paths are written."""
    def joined(a: Column, b: Column) -> Column:
        number = F.lpad((F.crc32(b.cast("binary")) % 10000).cast("string"), 4, "0")
        return F.array(F.concat(a, F.initcap(b)), F.concat(F.initcap(a), F.initcap(b)), F.concat_ws("_", a, b), F.concat_ws("-", a, b),
                       F.concat_ws("/", a, b), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat_ws("-", a, number))
    n = lambda w: F.greatest(F.size(w) - 1, F.lit(0))
    return let(words, lambda w: F.flatten(F.zip_with(F.slice(w, F.lit(1), n(w)), F.slice(w, F.lit(2), n(w)), joined)))


def train(docs: DataFrame, sample_documents: int = 5000, styled_documents: int = 500) -> list[float]:
    """Log-likelihood ratio of each transition, random strings against identifiers."""
    docs = docs.select("doc_id", "text")
    base = F.concat(_spans("assign", ASSIGN, ASSIGN_VALUE), _spans("access", ACCESS), _spans("hex", HEX))
    secret = docs.select(F.explode(F.array_distinct(F.transform(base, lambda s: s["value"]))).alias("token"), F.lit(True).alias("secret"))
    total = docs.count()
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(_text(), ASSIGN, " "), ACCESS, " "), HEX, " ")

    def sample(wanted: int) -> DataFrame:
        return docs.where(F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(1 << 50)) < int(min(1.0, wanted / max(1, total)) * (1 << 50)))
    plain = sample(sample_documents).select(F.explode(F.regexp_extract_all(bare, F.lit(IDENTIFIER), F.lit(0))).alias("token")).where(
        F.length("token") < LONG)
    styled = sample(styled_documents).select(F.explode(_styled(F.regexp_extract_all(F.lower(bare), F.lit("[a-z]{2,}"), F.lit(0)))).alias("token"))
    tokens = secret.unionByName(plain.unionByName(styled).withColumn("secret", F.lit(False)))
    counted = (tokens.groupBy("secret", "token").agg(F.count(F.lit(1)).alias("n"))
                     .select("secret", "n", F.explode(_transitions(F.col("token"))).alias("pair"))
                     .groupBy("secret", "pair").agg(F.sum("n").alias("n")).collect())   # at most 2 x 63 x 63 rows
    counts = {True: [0.0] * STATES ** 2, False: [0.0] * STATES ** 2}
    for r in counted:
        counts[r["secret"]][r["pair"]] = float(r["n"])
    return ratio_table(counts[True], counts[False])


def ratio_table(secret: list[float], plain: list[float], alpha: float = 0.5) -> list[float]:
    """Half of the random model is uniform: secrets seen so far use few alphabets. So is a small part of
    the other one: names hold letter pairs that the sample does not."""
    out = []
    for a in range(STATES):
        row = slice(a * STATES, (a + 1) * STATES)
        s, p = sum(secret[row]) + alpha * STATES, sum(plain[row]) + alpha * STATES
        out += [math.log(0.5 / STATES + 0.5 * (x + alpha) / s) - math.log(0.03 / STATES + 0.97 * (y + alpha) / p)
                for x, y in zip(secret[row], plain[row])]
    return out


def _outside(run: Column, base: Column) -> Column:
    """The parts of a run that no span of ``base`` (in order) covers, if long enough for a run."""
    part = lambda at, end: F.when(end - at >= SHORTEST, F.array(F.struct(
        at.alias("start"), run["kind"].alias("kind"), end.alias("end"),
        F.substring(run["value"], (at - run["start"] + 1).cast("int"), (end - at).cast("int")).alias("value")))).otherwise(
            F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>"))
    start = F.struct(run["start"].alias("at"), F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>").alias("out"))
    touching = F.filter(base, lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
    return F.aggregate(
        touching, start,
        lambda a, b: F.struct(F.greatest(a["at"], b["end"]).alias("at"), F.concat(a["out"], part(a["at"], b["start"])).alias("out")),
        lambda a: F.concat(a["out"], part(a["at"], run["end"])))


def _odds(table: list[float], log_prior: float):
    """Log odds that a run is random: the prior of its length and the ratio of every transition."""
    ratios = F.split(F.lit(",".join(f"{v:.6f}" for v in table)), ",").cast("array<double>")   # folded to a constant
    short = lambda run: F.greatest(F.lit(LONG) - F.char_length(run), F.lit(0))
    return lambda run: F.aggregate(_transitions(run), F.lit(log_prior) - short(run) * STEP, lambda a, t: a + F.get(ratios, t))


def _markov(table: list[float], log_prior: float, base: Column) -> Column:
    """Spans of runs outside ``base`` that look random against the prior odds."""
    odds = _odds(table, log_prior)
    parts = F.flatten(F.transform(_spans("markov", RUN), lambda run: _outside(run, base)))
    return F.filter(parts, lambda s: odds(s["value"]) > 0)


def find_secrets(docs: DataFrame, table: list[float], log_prior: float = LOG_PRIOR) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end) in order."""
    docs = docs.drop("base", "spans", "_markov")         # an input column named like a result is replaced
    bare = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = F.sort_array(bare(F.concat(_spans("assign", ASSIGN, ASSIGN_VALUE), _spans("access", ACCESS), _spans("hex", HEX))))
    found = docs.select("*", base.alias("base"))
    found = found.withColumn("_markov", bare(_markov(table, log_prior, F.col("base"))))
    return found.withColumn("spans", F.sort_array(F.concat("base", "_markov"))).drop("_markov")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, table: list[float], log_prior: float = LOG_PRIOR, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret's text replaced by ``mark``; other columns unchanged.

    Kinds are replaced one after the other; the mark itself matches none of them.
    """
    odds = _odds(table, log_prior)

    def replaced(text: Column, pattern: str, is_secret) -> Column:
        parts = F.struct(F.split(text, pattern, -1).alias("gaps"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"),
                         F.regexp_extract_all(text, F.lit(pattern), F.lit(2 if pattern == ASSIGN else 0)).alias("values"))
        rebuilt = let(parts, lambda p: F.array_join(F.transform(p["gaps"], lambda g, k: F.concat(g, F.when(
            k >= F.size(p["matches"]), "").when(is_secret(F.get(p["values"], k)), mark).otherwise(F.get(p["matches"], k)))), ""))
        return F.when(text.rlike(pattern), rebuilt).otherwise(text)

    always = lambda v: F.lit(True)
    random_run = lambda v: odds(v) > 0
    out = docs
    for pattern, test in ((ASSIGN, lambda v: F.char_length(v) >= ASSIGN_VALUE), (ACCESS, always), (HEX, always), (RUN, random_run)):
        out = out.withColumn("text", replaced(F.col("text"), pattern, test))
    return out
