"""Personal data: fixed patterns, and terms that reveal them, by corpus co-occurrence. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, save, sized
from .secrets import digest

# The kinds, in this order, and their patterns (repetitions that nothing follows are possessive: same matches, no backtracking).
KINDS = ("email", "ip", "card", "phone", "term")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
IP = r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A pair of term and entity must occur in so many different texts,
SUPPORT = 3
#: and the entity must follow from the term with at least this probability, and the term raise it by so many bits.
DISCLOSURE, BITS = 0.5, 4.0
_WORD = r"[\p{L}][\p{L}\p{M}'’-]+"


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substr(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: int, m: Column) -> Column:
    if kind == 1:
        return F.forall(F.split(m, r"\."), lambda x: x.cast("double") <= 255)
    if kind == 2:
        return F.when(F.length(_digits(m)).between(12, 19), _luhn(_digits(m))).otherwise(False)
    if kind == 3:
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _found(text: Column, pattern: Column, gate: Column) -> Column:
    """Array of (m, start, end) of all matches: what lies between them (split) and they themselves tell the offsets in code points."""
    none = F.from_json(F.lit("[]"), "array<struct<m:string,s:int,e:int>>")
    zipped = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.greatest(F.lit(1), F.size(F.regexp_extract_all(text, pattern, F.lit(0))))), F.regexp_extract_all(text, pattern, F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

    return F.when(gate, F.aggregate(F.filter(zipped, lambda x: x["m"].isNotNull()), start, add, lambda a: a["out"])).otherwise(none)


def _kind(kind: int, found: Column) -> Column:
    ok = F.filter(found, lambda x: _valid(kind, x["m"]))
    return F.transform(ok, lambda x: F.struct(x["s"].alias("start"), F.lit(kind).alias("kind"), x["e"].alias("end"), x["m"].alias("m")))


def _base(text: Column) -> Column:
    gates = (F.contains(text, F.lit("@")), text.rlike(r"[0-9]\.[0-9]"), text.rlike("[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), F.contains(text, F.lit("+")))
    parts = []
    for kind, (pattern, gate) in enumerate(zip((EMAIL, IP, CARD, PHONE), gates, strict=True)):
        parts.append(_kind(kind, _found(text, F.lit(pattern), gate)))
    return F.array_sort(F.concat(*parts))


def _without(text: Column, spans: Column) -> Column:
    """The text with each span replaced by a blank."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, x):
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(" "))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] < acc["at"], acc["out"]).otherwise(piece).alias("out"))

    rest = F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, rest).otherwise(text)


def disclosing_terms(texts: DataFrame, held: DataFrame) -> DataFrame | None:
    """(m, term, n, bits): terms that reveal the entity m, over the whole corpus; None if there are none.

    texts: (h, text) of all rows; held: (h, ms, rest) of those with entities ms, rest being the text without them. n and the
    texts with the term are counts of different texts: each of c copies counts 1 / c. n texts hold both anywhere, the term outside of entities;
    p(m | term) = n / those with the term; bits = log2(p(m | term) / p(m)), p(m) by rows. Words of two or more letters are terms. Texts
    with a term are counted over all documents, for those terms that can still reach the thresholds.
    """
    again = save(texts.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "again")
    total = max(1, texts.count())
    again = sized(again, 16)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0)))
    weigh = lambda df: df.join(again, "h", "left").withColumn("w", 1 / F.coalesce("c", F.lit(1)))
    number = F.round(F.sum("w")).cast("long")
    # n is at most the texts with m, and p at most 1: other entities cannot reach the least support or bits
    own = weigh(held).select("w", F.explode("ms").alias("m")).groupBy("m").agg(F.count("*").alias("own"), number.alias("different"))
    own = save(own.where((F.col("different") >= SUPPORT) & (F.col("own") * 2**BITS <= total)).drop("different"), "entities")
    with_m = held.select("h", F.explode("ms").alias("m")).distinct().join(sized(own, 128), "m", "left_semi").groupBy("h").agg(F.collect_set("m").alias("own_ms"))
    once = weigh(held).join(sized(save(with_m, "holders"), 256), "h").select("w", "own_ms", words("rest").alias("words"))
    once = save(once, "once")
    pairs = once.select("w", "own_ms", F.explode("words").alias("term")).select("w", F.explode("own_ms").alias("m"), "term")
    # a term is in at least as many texts as in those with any such entity: words that are common there go early
    seen = once.select("w", F.explode("words").alias("term")).groupBy("term").agg(number.alias("seen"))
    often = pairs.groupBy("m", "term").agg(number.alias("n")).where(f"n >= {SUPPORT}")
    often = save(often.join(seen, "term").where(f"n >= {DISCLOSURE} * seen").drop("seen"), "pairs")
    terms = save(often.select("term").distinct(), "terms")
    if terms.isEmpty():
        return None
    rest = texts.join(sized(save(held.select("h").distinct(), "held_h"), 8), "h", "left_anti").select("h", F.col("text").alias("rest")).union(held.select("h", "rest"))
    # a text's words differ already: partial sums, one row for each term and task, are all that is exchanged
    df = weigh(rest).select("w", F.explode(words("rest")).alias("term")).join(sized(terms, 64), "term", "left_semi").groupBy("term").agg(number.alias("df"))
    out = often.join(df, "term").join(own, "m").withColumn("p", F.col("n") / F.col("df")).withColumn("bits", F.log2(F.col("p") * total / F.col("own")))
    out = save(out.where(f"p >= {DISCLOSURE} and bits >= {BITS}").select("m", "term", "n", "bits"), "disclosing")
    return None if out.isEmpty() else out


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) for each row: base and all spans, arrays of (start, kind, end) sorted by start, then kind.

    Offsets count code points, ends are exclusive. Kind 4 ('term') marks, in documents that hold an entity, the terms
    that reveal it. Null and empty texts have no spans, very long ones are read whole; a null doc_id has its fixed patterns
    and terms like any other; rows that repeat an id or a text have equal spans for equal texts. Other columns are ignored,
    so none clash, and an empty table gives an empty table. A term that reveals several entities is marked once.
    """
    return _scanned(docs).drop("text")


def _scanned(docs: DataFrame) -> DataFrame:
    """scan() with the text."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    full = text.withColumn("b", _base(F.col("text")))
    ms = F.array_distinct(F.transform("b", lambda x: F.lower(x["m"])))
    held = save(full.where("size(b) > 0").select("h", ms.alias("ms"), _without(F.col("text"), F.col("b")).alias("rest")), "held")
    terms = disclosing_terms(text.select("h", "text"), held)
    base = F.transform("b", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    found = full.select("doc_id", "text", "h", base.alias("base"))
    if terms is None:
        release(held)
        return found.select("doc_id", "text", "base", F.col("base").alias("spans"))
    with_m = held.select("h", F.explode("ms").alias("m")).distinct()
    own = save(with_m.join(sized(terms, 128), "m").groupBy("h").agg(F.array_sort(F.collect_set("term")).alias("terms")), "own")
    release(held)
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{M}])(?:\Q"), F.array_join("terms", r"\E|\Q"), F.lit(r"\E)(?![\p{L}\p{M}])"))
    more = F.transform(_found(F.col("text"), pattern, F.lit(True)), lambda x: F.struct(x["s"].alias("start"), F.lit(4).alias("kind"), x["e"].alias("end")))
    return found.join(sized(own, 512), "h", "left").select("doc_id", "text", "base", F.array_sort(F.when(F.col("terms").isNull(), F.col("base")).otherwise(F.concat("base", more))).alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """The digest of scan() and the sanitised text: entities generalised to their kind, disclosing terms too. An unchanged text is its own."""
    found = _scanned(docs)
    clean = F.when(F.size("spans") > 0, redact(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return digest(found, KINDS, 4, clean.alias("sanitised"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets (a generalisation); a span that begins inside another is taken in by it."""
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(acc, x):
        inside = x["start"] < acc["at"]
        piece = F.concat(acc["out"], F.substr(text, acc["at"] + 1, x["start"] - acc["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(piece).alias("out"))

    return F.aggregate(spans, start, add, lambda a: F.concat(a["out"], F.substr(text, a["at"] + 1, F.length(text))))
