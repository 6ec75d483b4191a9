"""Line dedup: an exact set-similarity join of lines with prefix, positional and length filters. DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, release, save, sized

#: Counters of the rarity sketch: its size is fixed, whatever the vocabulary.
COUNTERS = 1 << 17
#: Prefix words are joined in so many turns, by their hash, so that the disk holds the exchange of one turn only.
PASSES = 2
#: Turns in which classes are compared with one earlier class that has the same extreme words, before the exact join of the rest;
#: none as soon as the pairs that share such words are fewer than a FEW-th of the classes: the exact join takes those as it takes all others.
LEADS, FEW = 4, 8
_ID = ["doc_id", "line_no", "th"]
_PARITY = ["p0", "p1"]
_SET = ["cid", "n", "p0"]
#: A set of up to LONG words has the first parity only: its 64 bits tell such sets apart. Words that make an end of a set.
LONG, TRIPLE = 64, 3


def _words(line: Column) -> Column:
    """The words of a line, or of a text, in lower case; a single blank splits without a regular expression."""
    low = F.lower(line)
    return F.array_remove(F.when(line.rlike(r"[\t\n\x0B\f\r]"), F.split(low, r"[ \t\n\x0B\f\r]+")).otherwise(F.split(low, " ")), "")


def rarity(docs: DataFrame) -> DataFrame:
    """One row (level): for each counter (word hash mod COUNTERS) the logarithmic class, 0 to 63, of its words' total count over
    all documents, in the place where keys have it. Only the order of words depends on it, so blanks alone part words here and capitals count apart."""
    words = docs.select(F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("w"))
    counts = words.groupBy(F.xxhash64("w").bitwiseAND(F.lit(COUNTERS - 1)).alias("c")).count()
    every = counts.union(docs.sparkSession.range(COUNTERS).select("id", F.lit(1).cast("long")))
    level = every.groupBy("c").agg(F.shiftleft(F.least(F.lit(63), F.floor(F.log(F.sum("count")) / 0.4)).cast("long"), 57).alias("v"))
    return save(level.agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("level")), "rarity")


def _keys(words: Column, level: Column) -> Column:
    """The different words as longs that sort by rarity, then hash: 6 bits of class, 57 of hash."""

    key = lambda h: F.get(level, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 7))
    return F.sort_array(F.array_distinct(F.transform(F.transform(words, lambda w: F.xxhash64(w)), key)))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _parity(keys: Column, half: bool) -> Column:
    """64 bits, each the parity of the number of words that hash to it; of all words, or of those with the next bit set."""
    one = F.lit(1).cast("long")
    some = lambda k: F.shiftright(k, 6).bitwiseAND(one) if half else one
    return F.aggregate(keys, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", some(k), k.bitwiseAND(F.lit(63)).cast("int"))))


def _numbered(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, th (the hash of the text), line_no and line, without a copy of the text beside each line."""
    return docs.select("doc_id", *more, F.xxhash64("text").alias("th"), "text").select("doc_id", "th", *more, F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _lines(docs: DataFrame, level: DataFrame) -> DataFrame:
    """What the join needs of each line with a word: its id (doc_id, line_no, th), its set's hash cid, size n, parities (p1 is null up to LONG words), the prefix head, and ends, hashes of two triples of the least and one of the greatest words of the set's rarer half in an order by hash."""
    lines = _numbered(docs).where(F.col("line").rlike(r"[^ \t\x0B\f\r]")).select(*_ID, _words(F.col("line")).alias("words"), level.scalar().alias("level"))
    keys = lines.select(*_ID, _keys(F.col("words"), F.col("level")).alias("keys"))
    n = F.size("keys")
    half = F.greatest(F.lit(2 * TRIPLE), F.floor((n + 3) / 2)).cast("int")
    mixed = F.sort_array(F.transform(F.slice("keys", F.lit(1), half), lambda k: F.shiftleft(k, 7)))
    all_, some = (_parity(F.col("keys"), bool(i)) for i in range(2))
    return keys.select(*_ID, "keys", mixed.alias("mixed")).select(
        *_ID, F.xxhash64("keys").alias("cid"), n.alias("n"), all_.alias("p0"), F.when(n > LONG, some).alias("p1"),
        F.array(*[F.xxhash64(F.slice("mixed", F.greatest(F.lit(1), at), F.lit(TRIPLE)), F.lit(i)) for i, at in enumerate((F.lit(1), F.lit(TRIPLE + 1), F.size("mixed") - TRIPLE + 1))]).alias("ends"),
        F.slice("keys", F.lit(1), n - F.floor((8 * n + 9) / 10).cast("int") + 1).alias("head"),
    )


#: a and b words can reach a similarity of 0.8 only by sharing 4 (a + b) / 9 of them.
_OVERLAP = "((4 * ({a} + {b}) + 8) div 9)"


def _bits(x: str, y: str, n: str = "{}.n") -> str:
    """Parity filter of two sets: their parities differ in at most as many bits as the sets in words; those of both halves of the words count apart where both sets have them."""
    a, b = n.format(x), n.format(y)
    all_, half = (f"({x}.{p} ^ {y}.{p})" for p in _PARITY)
    return f"(coalesce(bit_count({half}) + bit_count({all_} ^ {half}), bit_count({all_})) <= {a} + {b} - 2 * {_OVERLAP.format(a=a, b=b)})"


def _near(x: str, y: str) -> str:
    """Length and parity filter of two sets."""
    return f"(10 * least({x}.n, {y}.n) >= 8 * greatest({x}.n, {y}.n) and {_bits(x, y)})"


def _earlier(y: str, x: str, line: str = "{}.line_no") -> str:
    return f"({y}.doc_id < {x}.doc_id or {y}.doc_id = {x}.doc_id and {line.format(y)} < {line.format(x)})"


#: A prefix word's row holds numbers in pairs, so that little is exchanged: line_no and pos in lp, n and done in nd.
_LINE, _POS, _N, _DONE = "shiftright({}.lp, 32)", "({}.lp & 4294967295)", "shiftright({}.nd, 1)", "({}.nd & 1)"


def _possible(s: str, g: str) -> str:
    """Length, positional and parity filter of a word of the smaller set's index prefix that is in the greater set's prefix too.
    The first common word of a similar pair passes all of them."""
    a, b = _N.format(s), _N.format(g)
    order = f"({a} < {b} or {a} = {b} and {_earlier(s, g, _LINE)})"
    return f"(10 * {a} >= 8 * {b} and {a} <= {b} and {_bits(s, g, _N)} and {order} and least({a} - {_POS.format(s)}, {b} - {_POS.format(g)}) >= {_OVERLAP.format(a=a, b=b)})"


def _firsts(lines: DataFrame) -> tuple[Column, DataFrame]:
    """A number that orders lines by doc_id, then line_no (a long if the ids at hand allow, else a decimal), and a saved table of the first of it for each set that several lines have."""
    lo, hi, last = (x or 0 for x in lines.agg(F.min("doc_id"), F.max("doc_id"), F.max("line_no")).first())
    if (hi - lo + 1) * (last + 1) < 1 << 63:
        key = (F.col("doc_id") - F.lit(lo)) * F.lit(last + 1).cast("long") + F.col("line_no")
    else:
        key = (F.col("doc_id").cast("decimal(38,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no")).cast("decimal(38,0)")
    return key, save(lines.groupBy(*_SET).agg(F.min(key).alias("first"), F.count("*").alias("lines")).where("lines > 1").drop("lines"), "again")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The lines (doc_id, line_no, th) that have a pair (doc_id, line_no, y_doc, y_line) whose word sets, compared word by word, have a Jaccard similarity of at least 0.8."""
    x, y = pairs.select("doc_id", "line_no"), pairs.select(F.col("y_doc").alias("doc_id"), F.col("y_line").alias("line_no"))
    wanted = save(x.union(y).groupBy("doc_id").agg(F.collect_set("line_no").alias("nos")), "wanted")
    hit = _numbered(docs.join(sized(wanted, 64), "doc_id"), "nos")
    sets = save(hit.where(F.array_contains("nos", F.col("line_no"))).select(*_ID, "line").distinct(), "sets")
    other = sets.select(F.col("doc_id").alias("y_doc"), F.col("line_no").alias("y_line"), F.col("line").alias("y_text"))
    both = pairs.join(sets, ["doc_id", "line_no"]).join(other, ["y_doc", "y_line"])

    def similar(p: Column) -> Column:
        return _let(F.size(F.array_intersect(p["a"], p["b"])), lambda common: 10 * common >= 8 * (F.size(p["a"]) + F.size(p["b"]) - common))

    words = lambda c: F.array_distinct(_words(F.col(c)))
    out = save(both.where(_let(F.struct(words("line").alias("a"), words("y_text").alias("b")), similar)).select(*_ID).distinct(), "matched")
    release(wanted, sets)
    return out


def _led(docs: DataFrame, classes: DataFrame) -> list[DataFrame]:
    """Settles most members of large groups: each turn compares the classes that share an end with the earliest of them that has not led yet, one pair for each class.
    Ends are of three words, so that sets of other lines that only share some words by chance, more of them the more lines there are, have no leader in common."""
    struct = F.struct("doc_id", "line_no", "n", *_PARITY)
    own = classes.select(*_ID, "n", *_PARITY, F.explode("ends").alias("end"))
    pairs = (F.col("count") * (F.col("count") - 1) / 2).alias("pairs")
    shared = save(own.groupBy("end").count().where("count > 1").select("end", pairs), "shared")
    few, found = classes.count() // FEW, []
    if (shared.agg(F.sum("pairs")).first()[0] or 0) <= few:
        release(shared)
        return found
    rows = save(own.join(sized(shared.select("end"), 16), "end"), "rows")
    release(shared)
    for turn in range(LEADS):
        lead = rows.groupBy("end").agg(F.min(struct).alias("y"))
        led = save(rows.alias("x").join(lead, "end").where(_earlier("y", "x")).select("x.*", "y"), "led")
        release(rows)
        pairs = led.alias("x").where(_near("x", "y")).groupBy("x.doc_id", "x.line_no").agg(F.min("y").alias("y"))
        pairs = save(pairs.select("doc_id", "line_no", F.col("y.doc_id").alias("y_doc"), F.col("y.line_no").alias("y_line")), "pairs")
        if pairs.isEmpty():
            release(led, pairs)
            return found
        found.append(_verified(docs, pairs))
        rest = led.drop("y").join(sized(found[-1], 32), _ID, "left_anti")
        rows = save(rest, "rows") if turn + 1 < LEADS else None
        release(led, pairs)
        if rows is None or (rows.groupBy("end").count().agg(F.sum(F.col("count") * (F.col("count") - 1) / 2)).first()[0] or 0) <= few:
            break
    if rows is not None:
        release(rows)
    return found


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, nos): for each document that has any, the numbers (from 0) of its lines that match an earlier line; th is the hash of its text.

    Lines are ordered by doc_id, then number. Two lines match if their sets of lower-case words have a Jaccard similarity
    of at least 0.8; lines without a word match nothing. Equal sets form a class, represented by its first line. Words are
    ordered by rarity over all documents; classes that share a word of their prefixes and pass the length, positional and
    parity filters are compared word by word. Before that, classes that share extreme words are compared with leaders, so
    that members of a large group of near copies need one comparison or a few. Null or empty texts have no lines, and rows
    without doc_id take no part; lines of the same number in rows that repeat a doc_id are not earlier than each other
    unless they are equal sets of words, of which one stays. Very long lines and texts are lines like any other.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    if not docs.groupBy("doc_id", F.xxhash64("text")).count().where("count > 1").isEmpty():
        docs = docs.distinct()  # rows that are equal have equal lines
    level = rarity(docs)
    lines = save(_lines(docs, level), "lines")
    key, again = _firsts(lines)
    marked = lines.join(sized(again, 64), _SET, "left").withColumn("later", F.coalesce(key > F.col("first"), F.lit(False))).drop("first", "cid")
    marked = save(marked, "marked")
    classes, equal = marked.where("not later").drop("later"), marked.where("later").select(*_ID)
    release(lines, level, again)
    found = _led(docs, classes)
    flag = sized(save(reduce(DataFrame.union, found), "settled"), 32).withColumn("done", F.lit(1)) if found else None
    own = classes.withColumn("done", F.lit(0)) if flag is None else classes.join(flag, _ID, "left").withColumn("done", F.coalesce("done", F.lit(0)))
    parts = []
    for turn in range(PASSES):
        words = own.select("doc_id", "line_no", "n", *_PARITY, "done", F.posexplode("head").alias("pos", "tok")).where(F.pmod("tok", F.lit(PASSES)) == turn)
        pair = lambda high, low, bits: F.shiftleft(F.col(high).cast("long"), bits).bitwiseOR(F.col(low).cast("long"))
        packed = lambda rows: rows.select("tok", "doc_id", pair("line_no", "pos", 32).alias("lp"), pair("n", "done", 1).alias("nd"), *_PARITY)
        small = words.where("pos < n - (8 * n + 8) div 9 + 1")
        hit = packed(small).alias("s").join(packed(words).alias("g"), F.col("s.tok") == F.col("g.tok")).where(_possible("s", "g"))
        late = F.expr(_earlier("g", "s", _LINE))
        pick = lambda what, first, second: F.when(late, F.expr(what.format(first))).otherwise(F.expr(what.format(second)))
        line = lambda first, second: pick(_LINE, first, second).cast("int")
        hit = hit.where(pick(_DONE, "s", "g") == 0).select(pick("{}.doc_id", "s", "g").alias("doc_id"), line("s", "g").alias("line_no"), pick("{}.doc_id", "g", "s").alias("y_doc"), line("g", "s").alias("y_line"))
        parts.append(save(hit.distinct(), "part"))
        release(hit)  # nothing saved: its exchange may go
    rest = save(reduce(DataFrame.union, parts).distinct(), "rest")
    release(*parts)
    found.append(_verified(docs, rest))
    out = save(reduce(DataFrame.union, [equal, *found]).groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("line_no")).alias("nos")), "repeated")
    release(marked, rest, *found)
    return out


def dedup(docs: DataFrame) -> DataFrame:
    """docs with n_lines, n_removed and the text without its repeated lines (a null text stays null, and has no lines)."""
    docs = docs.drop("n_lines", "n_removed")
    i, th, gone = fresh(docs, "_id", "_th", "_nos")
    nos = repeated_lines(docs).select(F.col("doc_id").alias(i), F.col("th").alias(th), F.col("nos").alias(gone))
    same = (F.col("doc_id").cast("long") == F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(th))
    joined = docs.join(sized(nos, 96), same, "left")
    lines = F.split("text", "\n")
    kept = F.array_join(F.filter(lines, lambda line, at: ~F.array_contains(gone, at)), "\n")
    out = joined.withColumns({"n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_removed": F.coalesce(F.when(F.col("text").isNotNull(), F.size(gone)), F.lit(0)), "text": F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept)})
    return out.drop(i, th, gone)


def remove_lines(docs: DataFrame) -> DataFrame:
    """The pipeline's form: the columns of docs, n_chars counted anew where lines went; a document that lost lines and has no word left goes."""
    out = dedup(docs).where(~((F.col("n_removed") > 0) & ~F.col("text").rlike(r"\S")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c.replace('`', '``')}`") for c in docs.columns])
