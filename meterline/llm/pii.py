"""Personal data by patterns of form, and by contexts bootstrapped from what they find. DataFrame functions only.

Seeds (email, ip, card, phone) show which lexical patterns go with personal data: a field label before it ("contact:", "card
no ="), the three words before it, or two words before and one after. Patterns and the identifier-like values in them form a
bipartite graph; a pattern's score is the scored share of its values, a value's score the chance that one of its patterns is
right. After some rounds the values of high-confidence patterns are found too, whatever their form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, stage, without

KINDS = ("email", "ip", "card", "phone")
#: The contract's forms, written so that the regular-expression engine never backtracks over a run it has read: a match can
#: only begin where its run begins (or, for email, where the match before it ended).
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+\-])|\G)[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20\-])[0-9](?:[\x20\-]?[0-9]){15,18}+(?![\x20\-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9\-]+[0-9]",
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: Identifier-like: 6 characters or more, a digit among them.
VALUE = r"(?<![A-Za-z0-9._%+@\-])(?=[A-Za-z._%+@\-]*+[0-9])[A-Za-z0-9._%+@\-]{6,}+(?![A-Za-z0-9._%+@\-])"
#: A field label: a word and a sign before the value, quotes or brackets between.
LABEL = r"(\p{L}[\p{L}\p{N}_.]+)\x20{0,2}[:=#]\x20{0,2}[\"'(<\[]{0,2}"
#: The two or three words right before the value, and the word right after it.
BEFORE2, BEFORE3, AFTER = r"(\S+\s+\S+)\s+[\"'(<\[]{0,2}$", r"(\S+\s+\S+\s+\S+)\s+[\"'(<\[]{0,2}$", r"^[\"')>\]]{0,2}\s+(\S+)"
#: Characters before and after a value in which its context is looked for.
NEAR = 160
#: Rows and spans found by context that are sent to all tasks at most (some 10 MB); texts needn't be dealt out then.
MOST_SENT = 200_000
SPAN = "struct<kind:string,start:int,end:int,value:string,patterns:array<string>>"


def _let(value: Column, use) -> Column:
    """use(value), the value computed once."""
    return F.transform(F.array(value), use)[0]


def _running(values: Column, op) -> Column:
    """The running total of an array under an associative op, in n log n steps: after step k each place holds 2 ** k values."""
    steps = F.slice(F.sequence(F.lit(0), F.lit(30)), 1, F.ceil(F.log2(F.greatest(F.lit(1), F.size(values)))).cast("int"))

    def step(held, k):
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(held, lambda x, i: F.when(i >= back, op(x, F.get(held, i - back))).otherwise(x))

    return F.aggregate(steps, values, step)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))

    def add(total, i):
        n = d.substr(i, F.lit(1)).cast("int")
        twice = F.when(n > 4, 2 * n - 9).otherwise(2 * n)
        return total + F.when(i % 2 == 0, twice).otherwise(n)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(d))), F.lit(0), add) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _holding(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns that a value between the two texts is an instance of."""
    near, then = F.right(before, F.lit(NEAR)), F.left(after, F.lit(NEAR))
    label, two, three, next_word = F.regexp_extract(near, LABEL + "$", 1), F.regexp_extract(near, BEFORE2, 1), F.regexp_extract(near, BEFORE3, 1), F.regexp_extract(then, AFTER, 1)
    made = F.array(
        F.when(label != "", F.concat(label, F.lit(" ="))), F.when(three != "", F.concat(three, F.lit(" _"))),
        F.when((two != "") & (next_word != ""), F.concat(two, F.lit(" _ "), next_word)),
    )
    return F.transform(F.array_compact(made), lambda x: F.lower(F.regexp_replace(x, r"\s+", " ")))


def matches(text: Column, pattern: str, kind: str, worth: Column, contexts: bool) -> Column:
    """Non-overlapping matches from the left as spans in code points (end exclusive), with their patterns if `contexts`.

    The text between the matches gives their places; `worth` says cheaply whether a text can hold any.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("f"), F.split(text, pattern, -1).alias("g"))
    none = F.array().cast("array<string>")

    def spans(p):
        sizes = F.zip_with(F.slice(p["g"], 1, F.size(p["f"])), p["f"], lambda g, f: F.length(g) + F.length(f))
        named = lambda v, i: _patterns(F.get(p["g"], i), F.get(p["g"], i + 1)) if contexts else none
        made = lambda ends: F.transform(p["f"], lambda v, i: F.struct(F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(v)).alias("start"), F.get(ends, i).alias("end"), v.alias("value"), named(v, i).alias("patterns")))
        return _let(_running(sizes, lambda x, y: x + y), made)

    return F.when(worth, _let(both, spans)).otherwise(F.array().cast(f"array<{SPAN}>"))


def with_base(df: DataFrame, text: str = "text", contexts: bool = False) -> DataFrame:
    """df with `__base`: the spans of the four forms that hold, by kind as listed, then by start. Null and empty texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    worth = {"email": F.instr(t, "@") > 0, "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]{2}|[0-9][ -][0-9]"), "phone": F.instr(t, "+") > 0}
    spans = [_holding(k, matches(t, PATTERNS[k], k, worth[k], contexts)) for k in KINDS]
    return df.withColumn("__base", F.concat(*spans))


def _clear_of(found: Column, base: Column) -> Column:
    """Those of `found` that overlap none of `base`: both in order of start, with how far base spans reach and where the next starts."""
    place = lambda flag: lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(flag).alias("new"), i.alias("no"))
    order = F.array_sort(F.concat(F.transform(base, place(False)), F.transform(found, place(True))))

    def kept(o):
        reach = _running(F.transform(o, lambda x: F.when(x["new"], -1).otherwise(x["end"])), lambda x, y: F.greatest(x, y))
        ahead = F.reverse(_running(F.reverse(F.transform(o, lambda x: F.when(x["new"], 2**31 - 1).otherwise(x["start"]))), lambda x, y: F.least(x, y)))
        free = _let(F.struct(reach.alias("r"), ahead.alias("a")), lambda s: F.filter(o, lambda x, i: x["new"] & (F.get(s["r"], i) <= x["start"]) & (F.get(s["a"], i) >= x["end"])))
        return F.transform(free, lambda x: x["no"])

    return _let(found, lambda f: F.transform(_let(order, kept), lambda no: F.get(f, no)))


def learn_contexts(found: DataFrame, rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """Pairs (label, value) to be found by context, from `found` (label, value, seed); a label is any pattern.

    Edges are distinct pairs, so copies of a document add nothing. A label needs `support` distinct scored values, so those with
    fewer values of any kind are left out at once; what the graph holds is spread by label, then by value, and only sums and
    counts cross the network.
    """
    pairs = stage(found.groupBy("label", "value").agg(F.max("seed").alias("seed")), "pii-pairs")
    edges = stage(pairs.join(pairs.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("label"), "label"), "pii-edges")
    known = edges.groupBy("value").agg(F.max("seed").alias("score"))
    labels = None
    for _ in range(rounds):
        scored = edges.join(known, "value").withColumn("score", F.greatest(F.col("seed"), F.col("score")))
        labels = stage(scored.groupBy("label").agg((F.sum("score") / F.count("*")).alias("trust"), F.sum((F.col("score") >= 0.5).cast("int")).alias("n")).where(F.col("n") >= support).select("label", "trust"), "pii-labels")
        miss = F.least(F.lit(0.0), F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("trust")))))
        known = stage(edges.join(labels, "label").groupBy("value").agg((1 - F.exp(miss)).alias("score"), F.max("seed").alias("seed")).select("value", F.greatest("score", F.col("seed")).alias("score")), "pii-values")
        known = known.unionByName(edges.where("seed > 0").join(known, "value", "left_anti").groupBy("value").agg(F.max("seed").alias("score")))
    sure = labels.where(F.col("trust") >= confidence).select("label")
    good = known.where(F.col("score") >= confidence).select("value")
    return edges.where("seed = 0").join(sure, "label", "left_semi").join(good, "value", "left_semi").select("label", "value")


def find_pii(df: DataFrame, row_id: str = "doc_id", text: str = "text", rounds: int = 3, support: int = 5, confidence: float = 0.8) -> DataFrame:
    """df with `base` and `spans`, arrays of struct (kind, start, end): the four forms, and those with what contexts add.

    Spans count code points from 0, end exclusive; base spans are by kind as listed, then start; those of kind `context` follow
    and never overlap a base span. Null and empty texts have none; repeated rows get the same spans; columns named base or
    spans are replaced, others pass through.
    """
    df = without(df, "base", "spans").withColumns({"__id": F.col(row_id), "__row": F.xxhash64(F.col(row_id), F.col(text))})
    based = with_base(df, text)
    t = F.coalesce(F.col(text), F.lit(""))
    # what has no digit and no sign of an address holds neither seeds nor identifiers
    some = with_base(df.where(t.rlike("[0-9@]")), text, contexts=True)
    other = _clear_of(matches(t, VALUE, "context", F.lit(True), True), F.col("__base"))
    every = some.select("__id", "__row", F.explode(F.concat("__base", other)).alias("s")).select("__id", "__row", "s.*")
    seen = stage(every.where(F.size("patterns") > 0).select("__id", "__row", "kind", "start", "end", "value", F.explode("patterns").alias("label")), "pii-seen", few=True)
    chosen = learn_contexts(seen.select("label", "value", (F.col("kind") != "context").cast("double").alias("seed")), rounds, support, confidence)
    added = seen.where("kind = 'context'").join(chosen, ["label", "value"], "left_semi")
    bare = "struct<kind:string,start:int,end:int>"
    added = stage(added.groupBy("__id", "__row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("__more")), "pii-added", few=True)
    # a table whose spans are counted and few goes to the texts; a larger one meets them by id
    held = added.agg(F.count("*") + F.coalesce(F.sum(F.size("__more")), F.lit(0))).first()[0]
    added = F.broadcast(added) if held <= MOST_SENT else added
    short = F.transform("__base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    out = based.withColumn("base", short).drop("__base")
    joined = out.join(added.withColumnsRenamed({"__id": "__aid", "__row": "__arow"}), F.col("__id").eqNullSafe(F.col("__aid")) & (F.col("__row") == F.col("__arow")), "left")
    more = F.coalesce(F.col("__more"), F.array().cast(f"array<{bare}>"))
    return joined.withColumn("spans", F.concat("base", more)).drop("__id", "__row", "__aid", "__arow", "__more")


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with each span of the text replaced by its kind in brackets; overlapping spans become one, named after the first."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    # code points of four bytes each, so a piece is found without a walk through the text; a blank keeps marks from being read as one
    wide = F.encode(F.col(text), "UTF-32")
    piece = lambda w, a, n: F.substr(F.decode(F.concat(F.unhex(F.lit("00000020")), F.substr(w, 4 * a + 1, 4 * n)), "UTF-32"), F.lit(2))

    def masked(o):
        reach = _running(F.transform(o, lambda s: s["end"]), lambda x, y: F.greatest(x, y))

        def cut(x):
            at = lambda i: F.when(i > 0, F.get(x["r"], i - 1)).otherwise(0)
            parts = F.transform(o, lambda s, i: F.when(s["start"] >= at(i), F.concat(piece(x["w"], at(i), s["start"] - at(i)), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
            end = F.element_at(x["r"], -1)
            return F.concat(F.array_join(parts, ""), piece(x["w"], end, F.length(F.col(text)) - end))

        return _let(F.struct(reach.alias("r"), wide.alias("w")), cut)

    return df.withColumn(text, F.when(F.size(spans) > 0, _let(order, masked)).otherwise(F.col(text)))


def digest(found: DataFrame) -> DataFrame:
    """Counts of base spans by kind, and the spans as kind:start:end, comma-joined."""
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = {f"n_{k}": number(k) for k in KINDS}
    return found.withColumns(counts | {"base_sha256": F.sha2(line("base").cast("binary"), 256), "spans": line("spans")})


def op4_contextual_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of `documents`."""
    found = find_pii(documents(spark, sf_dir).select("doc_id", "text")).withColumn("n_spans", F.size("spans").cast("long"))
    return digest(found).select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans")
