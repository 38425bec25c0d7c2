"""Personal data: generators of candidate spans, boosted trees, calibrated thresholds.

All of it is DataFrame functions and Spark ML.  Base spans are matches of four patterns that pass
their checks.  Wider generators propose further, overlapping spans in other notations: spelled-out
addresses, defanged and long host addresses, numbers without a plus, cards with other separators,
bank account and social security numbers.

Labels need no base match of the candidate itself.  ``evidence`` is 1 where a check that chance
rarely passes holds or a word before the candidate names it, 0 where a check fails or a word before
it names something else, and null otherwise; none of these words is a feature (checks are).  Base matches, and
matches of base patterns that fail, are also rewritten into the wider notations where they stand,
as right and wrong examples of them.  Boosted trees learn the labels from format and surroundings.
All labelled candidates take part, a quarter of them kept out of the fit.  For each kind the
threshold is the least that reaches ``PRECISION`` on that quarter, (right + 1) / (all + 2); a kind
without such a threshold adds none.  Candidates become spans if they touch no base span, their evidence is not 0 and their score
reaches the threshold.

A null text is empty and has no spans.  Rows equal in id and text get the same spans.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

KINDS = ("email", "ip", "card", "phone")
# The base patterns.  Repeats are possessive, and a match begins at the start of a run
# of its characters or where the last match ended: this matches the same in linear time and needs no
# stack for long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried: one character of these.
NEEDS = {"email": "@", "phone": "+"}
#: Generators of further candidates and the kind that their spans get.
WIDER = {
    "email": r"[A-Za-z0-9._%+-]{1,64}\x20?(?:[\[({]at[\])}]|\x20at\x20|@)\x20?[A-Za-z0-9-]{1,63}"
             r"(?:(?:\x20?[\[({]dot[\])}]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]{1,63}){1,4}",
    "ip": r"(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}"
          r"|[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}",
    "card": r"[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{4}){2,3}[0-9]{0,3}|[0-9]{3}-[0-9]{2}-[0-9]{4}"
            r"|\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "phone": r"(?:\(?\+?[0-9]{1,4}\)?[\x20./-]{0,2}){1,2}[0-9]{3,4}[\x20./-]?[0-9]{3,4}",
}
PRECISION = 0.95
AROUND = 24
FEATURES = ("size", "digits", "letters", "marks", "groups", "spaces", "distinct", "plus", "at",
            "colons", "dots", "left_word", "right_word", "left_digit", "right_digit", "left_colon",
            "check",
            *(f"is_{k}" for k in KINDS))
# Words before a candidate that speak for it, words right before it that speak
# against it, and last labels of host names.
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|write|contact|reach|address)",
    "ip": r"(?i)\b(?:ip|ipv6|host|server|address|login|from)\b",
    "card": r"(?i)\b(?:ssn|social security)",
    "phone": r"(?i)\b(?:phone|tel|call|fax|mobil|cell|dial|whatsapp|contact)",
}
AGAINST = (r"(?i)(?:\b(?:order|ref|reference|invoice|id|no|sku|isbn|page|version|ticket|case|serial|"
           r"item|part|zip|year|total|price|build|release|line|commit)\W{0,3}|#)$")
SOCIAL = r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"
TOP_LEVEL = r"(?i)^(?:com|org|net|edu|gov|mil|int|info|biz|name|dev|app|[a-z]{2})$"


def running(lengths: Column) -> Column:
    """Sums of an array up to each place: one doubling of the reach at a time."""
    rounds = F.ceil(F.log2(F.greatest(F.size(lengths), F.lit(2)))).cast("int") - 1

    def double(acc: Column, k: Column) -> Column:
        reach = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(acc, lambda x, i: x + F.when(i >= reach, F.get(acc, i - reach))
                           .otherwise(F.lit(0)))

    return F.aggregate(F.sequence(F.lit(0), rounds), lengths, double)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, word, left, right), code points.

    The text is cut once at the matches; sums of lengths give the places.  ``left`` are up to
    ``AROUND`` characters before the match, back to the begin of the match before it, ``right`` is
    the next character.  Each piece is read a fixed number of times, so long texts take time in
    proportion to their length (sums: times the logarithm of the number of matches).
    """
    words = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    cut = F.struct(words.alias("words"), gaps.alias("gaps"))
    span = ("array<struct<start:int,end:int,word:string,left:string,right:string>>")

    def place(c: Column) -> Column:
        ends = running(F.transform(c["words"], lambda w, i: F.length(w) + F.length(F.get(c["gaps"], i))))
        return F.transform(F.arrays_zip(c["words"].alias("w"), ends.alias("e")), lambda z, i: F.struct(
            (z["e"] - F.length(z["w"])).alias("start"), z["e"].alias("end"), z["w"].alias("word"),
            F.right(F.concat(F.when(i > 0, F.get(c["words"], i - 1)).otherwise(F.lit("")),
                             F.get(c["gaps"], i)), F.lit(AROUND)).alias("left"),
            F.substring(F.concat(F.get(c["gaps"], i + 1), F.coalesce(
                F.get(c["words"], i + 1), F.lit(""))), 1, 1).alias("right")))

    # one element, so that the cut is made once and read by name
    found = F.flatten(F.transform(F.array(cut), place))
    return F.when(F.size(words) > 0, found).otherwise(F.array().cast(span))


def _digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of 13 to 19 digits passes the check; false for other lengths."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.when(n.between(13, 19), n).otherwise(1)),
                        F.lit(0), add)
    return n.between(13, 19) & (total % 10 == 0)


def passes(kind: str, word: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(word, r"\."), lambda p: (F.length(part(p)) < 3) | (
            (F.length(part(p)) == 3) & (part(p) <= F.lit("255"))))
    if kind == "card":
        return luhn(_digits(word))
    if kind == "phone":
        return F.length(_digits(word)).between(9, 15)
    return F.lit(True)


def account_number(word: Column) -> Column:
    """Whether the check digits of an international bank account number are right (modulo 97)."""
    plain = F.regexp_replace(word, " ", "")
    turned = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))

    def add(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), add) == 1


def check(kind: Column, word: Column) -> Column:
    """Check digits and ranges of numbers: 1 right, -1 wrong, 0 where a notation has none."""
    right = (F.when((kind == "card") & word.rlike("^[A-Z]"), account_number(word))
             .when((kind == "card") & word.rlike(SOCIAL), ~word.rlike(r"^(?:000|666|9)|-00-|0000$"))
             .when(kind == "card", luhn(_digits(word)))
             .when((kind == "ip") & ~F.contains(word, F.lit(":")),
                   passes("ip", F.regexp_replace(word, r"[\[\]]", ""))))
    return F.when(right, 1).when(~right, -1).otherwise(0)


def evidence(kind: Column, word: Column, left: Column) -> Column:
    """1, 0 or null: what checks and the words before a candidate say about it."""
    n = F.length(_digits(word))
    named = F.coalesce(*[F.when(kind == k, left.rlike(p)) for k, p in FOR.items()])
    other = left.rlike(AGAINST)
    said = F.when(other, 0).when(named, 1)
    last = F.regexp_extract(word, "([A-Za-z0-9-]+)$", 1)
    email = F.when(~last.rlike(TOP_LEVEL), 0).otherwise(said)
    groups = F.size(F.split(word, ":"))
    short = F.contains(word, F.lit("::"))
    long_ip = F.when((groups == 8) & word.rlike("[A-Fa-f]"), 1).when(
        ~short & (groups != 8) | (groups > 8), 0).otherwise(said)
    ok = check(kind, word)
    ip = F.when(F.contains(word, F.lit(":")), long_ip).when(ok < 0, 0).otherwise(said)
    card = F.when(ok < 0, 0).when(~word.rlike(SOCIAL), 1).otherwise(said)
    phone = F.when(~n.between(9, 15), 0).otherwise(said)
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card) \
        .when(kind == "phone", phone)


def rewritten(kind: str, word: Column, start: Column) -> Column:
    """A match of a base pattern in a wider notation, picked by hash; null where none fits."""
    pick = lambda *texts: F.get(F.array(*[F.lit(t) for t in texts]),
                                F.pmod(F.hash(word, start), F.lit(len(texts))))
    digits = _digits(word)
    out = {
        "email": F.concat(F.substring_index(word, "@", 1), pick(" [at] ", " at ", "(at)", " (at) "),
                          F.regexp_replace(F.substring_index(word, "@", -1), F.lit(r"\."),
                                           pick(" [dot] ", " dot ", ".", " (dot) "))),
        "ip": F.regexp_replace(word, r"\.", "[.]"),
        "card": F.regexp_replace(digits, F.lit("([0-9]{4})(?=[0-9])"),
                                 F.concat(F.lit("$1"), pick(".", "_", "/", " - "))),
        "phone": F.regexp_replace(word, F.lit(r"^\+"), pick("", "", "00", "(")),
    }[kind]
    return F.when(out.rlike(f"^(?:{WIDER[kind]})$"), out)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id, base, wider, turned): spans (kind, start, end, word, left, right) of every row.

    ``turned`` are base matches and failed ones in wider notations, with their label ``y``.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    name = F.coalesce(F.concat(F.col("id").cast("string"), F.lit("\u0001")), F.lit("\u0002"))
    rows = rows.select(F.md5(F.concat(name, "text")).alias("key"), "id", "text").withColumn(
        "numbers", F.col("text").rlike("[0-9]"))
    text = F.col("text")
    for name, patterns in (("b", BASE), ("w", WIDER)):
        for kind, pattern in patterns.items():
            need = F.contains(text, F.lit(NEEDS[kind])) if name == "b" and kind in NEEDS \
                else F.col("numbers") if kind != "email" else F.lit(True)
            if name == "w" and kind == "email":
                need = text.rlike(r"@|(?i)[\[({ ]at[\])} ]")
            # the text is cut to nothing where a pattern cannot match
            rows = rows.withColumn(f"{name}_{kind}", matches(
                F.when(need, text).otherwise(F.lit("")), pattern))

    def full(kind: str, found: Column) -> Column:
        return F.transform(found, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"], s["end"], s["word"], s["left"], s["right"]))

    def good(kind: str) -> Column:
        return F.filter(f"b_{kind}", lambda s: passes(kind, s["word"]))

    def turn(kind: str) -> Column:
        return F.filter(F.transform(f"b_{kind}", lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"], s["end"],
            rewritten(kind, s["word"], s["start"]).alias("word"), s["left"], s["right"],
            passes(kind, s["word"]).cast("int").alias("y"))), lambda s: s["word"].isNotNull())

    return rows.select("key", "id", F.concat(*[full(k, good(k)) for k in KINDS]).alias("base"),
                       F.concat(*[full(k, F.col(f"w_{k}")) for k in KINDS]).alias("wider"),
                       F.concat(*[turn(k) for k in KINDS]).alias("turned"))


def features(c: Column) -> list[Column]:
    word = c["word"]
    count = lambda p: F.length(F.regexp_replace(word, p, "")).cast("double")
    out = {
        "size": F.length(word), "digits": count("[^0-9]"), "letters": count("[^A-Za-z]"),
        "marks": count("[A-Za-z0-9]"), "groups": F.size(F.split(word, "[^A-Za-z0-9]+")),
        "spaces": count("[^ ]"), "distinct": F.size(F.array_distinct(F.split(word, ""))),
        "plus": count("[^+]"), "at": count("[^@]"), "colons": count("[^:]"), "dots": count("[^.]"),
        "left_word": c["left"].rlike(r"[\p{L}0-9]$"), "right_word": c["right"].rlike(r"[\p{L}0-9]"),
        "left_digit": c["left"].rlike(r"[0-9][ .-]?$"), "right_digit": c["right"].rlike("[0-9]"),
        "left_colon": c["left"].rlike(r"[:=]\s?$"),
        "check": check(c["kind"], word)}
    out |= {f"is_{k}": c["kind"] == k for k in KINDS}
    return [v.cast("double").alias(k) for k, v in out.items()]


def untouched(found: DataFrame) -> DataFrame:
    """(key, c): the wider candidates that share no character with a base span of their text.

    A candidate touches one if the furthest end of the base spans that begin before its end lies
    beyond its start: one pass over the spans of a text in order.
    """
    base = found.select("key", F.explode("base").alias("b")).select(
        "key", F.col("b.start").alias("at"), F.lit(1).alias("last"), F.col("b.end").alias("reach"),
        F.lit(None).alias("c"))
    wider = found.select("key", F.explode("wider").alias("c")).select(
        "key", F.col("c.end").alias("at"), F.lit(0).alias("last"), F.lit(None).cast("int").alias("reach"), "c")
    before = Window.partitionBy("key").orderBy("at", "last").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (wider.union(base).withColumn("reach", F.max("reach").over(before))
            .filter(F.col("c").isNotNull() & (F.coalesce("reach", F.lit(-1)) <= F.col("c.start")))
            .select("key", "c"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  precision: float = PRECISION) -> DataFrame:
    """(id, base, more): arrays of spans (kind, start, end); ``more`` are the accepted candidates.

    Trees learn from every labelled candidate but a quarter, thresholds from that whole quarter.
    """
    found = staged(candidates(docs, id_col, text_col))
    once = found.filter("size(wider) > 0 or size(turned) > 0").select(
        "key", "base", "wider", "turned").dropDuplicates(["key"])
    parts = ("kind", "start", "end")
    real = untouched(once).select(
        "key", *(F.col(f"c.{k}").alias(k) for k in parts), F.lit(False).alias("made"),
        evidence(F.col("c.kind"), F.col("c.word"), F.col("c.left")).cast("double").alias("y"),
        *features(F.col("c")))
    made = once.select("key", F.explode("turned").alias("c")).select(
        "key", *(F.col(f"c.{k}").alias(k) for k in parts), F.lit(True).alias("made"),
        F.col("c.y").cast("double").alias("y"), *features(F.col("c")))
    rows = staged(real.union(made))
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    slim = F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"]))
    known = rows.filter("y is not null")
    held = F.pmod(F.xxhash64("end", "start", "key"), F.lit(4)) == 0
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    data = known.select("kind", "y", held.alias("held"), *FEATURES)
    fit = data.filter("not held")
    # two rows at most; all right or all wrong: nothing to learn from
    if {r.y for r in fit.select("y").distinct().collect()} != {0.0, 1.0}:
        return found.select("id", slim.alias("base"), none.alias("more"))
    trees = GBTClassifier(featuresCol="x", labelCol="y", maxIter=20, maxDepth=4, maxBins=32,
                          seed=5).fit(vectors.transform(fit))
    p = vector_to_array("probability")[1]
    # how many candidates of a kind have at least a score, in steps of a hundredth
    steps = (trees.transform(vectors.transform(data.filter("held")))
             .groupBy("kind", F.floor(p * 100).cast("int").alias("step"))
             .agg(F.sum("y").alias("right"), F.count("*").alias("n")).collect())
    least = {}
    for kind in KINDS:
        right = n = 0.0
        for r in sorted((r for r in steps if r.kind == kind), key=lambda r: -r.step):
            right, n = right + r.right, n + r.n
            if (right + 1) / (n + 2) >= precision:
                least[kind] = r.step / 100
    bar = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in least.items()], F.lit(2.0))
    asked = rows.filter("not made and coalesce(y, 1) > 0")
    more = (trees.transform(vectors.transform(asked)).filter(p >= bar)
            .groupBy("key").agg(F.collect_set(F.struct(*parts)).alias("more")))
    return (found.join(more.withColumnRenamed("key", "m_key"), F.col("key") == F.col("m_key"), "left")
            .select("id", slim.alias("base"), F.coalesce("more", none).alias("more")))


def in_order(spans: Column) -> Column:
    """By kind as listed, then start, then end."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    return F.sort_array(F.transform(spans, lambda s: F.struct(
        rank[s["kind"]].alias("rank"), s["start"].alias("start"), s["end"].alias("end"),
        s["kind"].alias("kind"))))
