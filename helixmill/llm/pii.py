"""Personal data: fixed patterns with checks, and bootstrapped contextual extraction on top.

Matches of the fixed patterns are seeds, and so are long mixed strings right after a word such as "token". The word
before a seed, the two words before it and the word after it are lexical patterns; a pattern-instance graph joins these
to all tokens with a digit or an at sign that they stand beside anywhere. Round after round, a pattern's confidence is
the mean score of its instances and an unseen instance scores DAMPING times its best pattern, until no score moves by
more than SETTLED; scores only rise and each round adds at most DAMPING of the last one's rise, so that takes few
rounds. Patterns that end above CONFIDENT, with enough different seeds, give the tokens that no fixed pattern found, if
these look like the seeds' kind.

Only DataFrame functions. Texts are read once and never shuffled: positions come from the lengths of the matches and of
the parts between them; what goes on is one row of spans a document and the tokens.
Regular expressions only move forward (possessive), so junk without spaces takes linear time.

Null and empty texts have no spans. Tokens without a word beside them belong to no pattern. Rows that repeat get equal
results; a null doc_id is a name like others. Ties between kinds of a pattern go to the kind listed first. Only doc_id
and text are read, so other columns cannot clash; columns of the results start with ``pii_``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixmill.llm._common import let, row_key, stage, table

KINDS = ["email", "ip", "card", "phone"]
#: Found by context alone, after the kinds with fixed patterns.
SECRET, SECRET_WORDS = "secret", ("token", "secret", "password", "passwd", "apikey", "key", "bearer")
LOCAL = r"[A-Za-z0-9._%+-]"
#: Each matches what the contract's pattern matches, or more that its check then drops, without going back.
FIND = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[ -][0-9]++)*+",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
#: A token with a digit or at sign, with the tokens of digits that follow it.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:[ ][(+]?[0-9][0-9().-]*+(?!\S))*+"
CONFIDENT, LEAST_SEEDS, DAMPING, SETTLED = 0.8, 5, 0.5, 0.01
BESIDE = " \t\n\x0b\x0c\r:;,.=#()\"'"
#: Matches whose places are summed up in one list.
CHUNK = 256
SPAN = "struct<start:int,end:int,m:string>"


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    doubled = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    def add(total: Column, i: Column) -> Column:
        d = F.substr(number, F.char_length(number) - i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, F.get(doubled, d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.char_length(number)), F.lit(0), add) % 10 == 0


CHECK = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"),
    "card": lambda m: let(digits(m), lambda d: F.when(F.char_length(d).between(13, 19), luhn(d)).otherwise(False)),
    "phone": lambda m: F.char_length(digits(m)).between(9, 15),
}
NEEDED = {"email": "@", "ip": ".", "phone": "+"}


def located(text: Column, pattern: str, keep, more=None) -> Column:
    """Spans (start, end, m) of the matches that keep accepts; more(before, after) adds a list of strings from the texts
    beside a match."""
    fields = lambda a, x: [(a["at"] + x["g"]).alias("start"), (a["at"] + x["g"] + x["n"]).alias("end"), x["m"].alias("m")]
    kind = SPAN if more is None else SPAN[:-1] + ",beside:array<string>>"
    def walk(matches: Column) -> Column:
        def told(gaps: Column) -> Column:
            beside = F.zip_with(gaps, F.slice(gaps, 2, F.size(gaps)), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
            return F.zip_with(matches, F.slice(beside, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.char_length(g["x"]).alias("g"), F.char_length(m).alias("n"), *([more(g["x"], g["y"]).alias("beside")] if more else [])))
        def step(a: Column, x: Column) -> Column:
            own = F.struct(*fields(a, x), *([x["beside"].alias("beside")] if more else []))
            return F.struct((a["at"] + x["g"] + x["n"]).alias("at"), F.when(keep(x["m"]), F.concat(a["out"], F.array(own))).otherwise(a["out"]).alias("out"))
        none = F.array().cast(f"array<{kind}>")
        # places are sums over the matches before; by chunks, as a list that grows by one is copied each time
        def cut(both: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.floor((F.size(both) - 1) / CHUNK).cast("int")), lambda c: F.slice(both, c * CHUNK + 1, F.lit(CHUNK)))
        def placed(parts: Column) -> Column:
            length = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x["g"] + x["n"])
            begins = F.aggregate(F.transform(parts, length), F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"])
            return F.flatten(F.zip_with(parts, begins, lambda part, at: F.aggregate(part, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))
        return F.when(F.size(matches) == 0, none).otherwise(let(let(let(F.split(text, pattern, -1), told), cut), placed))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)


def base_spans(text: Column, kind: str) -> Column:
    found = located(text, FIND[kind], CHECK[kind])
    return F.when(F.contains(text, F.lit(NEEDED[kind])), found).otherwise(F.array().cast(f"array<{SPAN}>")) if kind in NEEDED else found


def last_word(text: Column) -> Column:
    """The last word, all letters, before what may stand between a word and a token; else nothing."""
    bare = F.rtrim(text, F.lit(BESIDE))
    word = F.substring_index(F.substring_index(F.substring_index(bare, " ", -1), "\n", -1), "\t", -1)
    return F.when(word.rlike(r"^\p{L}{2,}$"), F.lower(word)).otherwise("")


def first_word(text: Column) -> Column:
    bare = F.ltrim(text, F.lit(BESIDE))
    word = F.substring_index(F.substring_index(F.substring_index(bare, " ", 1), "\n", 1), "\t", 1)
    return F.when(word.rlike(r"^\p{L}{2,}[:;,.)]*$"), F.lower(F.rtrim(word, F.lit(BESIDE)))).otherwise("")


def patterns(before: Column, after: Column) -> Column:
    """Up to three patterns: "word _", "two words _" and "_ word"."""
    def two(word: Column) -> Column:
        cut = F.rtrim(before, F.lit(BESIDE))
        other = last_word(F.left(cut, F.char_length(cut) - F.char_length(word)))
        return F.array(F.when(word != "", F.concat(word, F.lit(" _"))), F.when((word != "") & (other != ""), F.concat(other, F.lit(" "), word, F.lit(" _"))))

    right = let(first_word(after), lambda w: F.when(w != "", F.concat(F.lit("_ "), w)))
    return F.array_compact(F.concat(let(last_word(before), two), F.array(right)))


def tokens(text: Column) -> Column:
    """Tokens with a digit or an at sign, with the patterns beside them."""
    return F.filter(located(text, TOKEN, lambda m: F.lit(True), patterns), lambda x: F.size(x["beside"]) > 0)


def found_in(docs: DataFrame) -> DataFrame:
    """One row a document: its base spans by kind, and its tokens, bare of punctuation."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = lambda x: F.struct((x["start"] + F.char_length(F.regexp_extract(x["m"], r"^[^\p{L}0-9+]*", 0))).alias("start"), (x["end"] - F.char_length(F.regexp_extract(x["m"], r"[^\p{L}0-9]*$", 0))).alias("end"), F.regexp_replace(x["m"], r"^[^\p{L}0-9+]+|[^\p{L}0-9]+$", "").alias("m"), x["beside"].alias("beside"))
    spans = {f"pii_{k}": base_spans(text, k) for k in KINDS}
    return docs.select("doc_id", row_key().alias("pii_key"), *[c.alias(n) for n, c in spans.items()], F.transform(tokens(text), bare).alias("pii_tokens"))


def mixed(token: Column) -> Column:
    """Long and of letters and digits, as keys and passwords are."""
    return token.rlike(r"^[A-Za-z0-9+/_-]{20,}+=*$") & token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def looks_like(kind: Column, token: Column) -> Column:
    n = F.char_length(digits(token))
    return F.when(kind == SECRET, mixed(token)).when(kind == "email", F.contains(token, F.lit("@"))).when(kind == "ip", token.rlike(r"^[0-9]+([.:][0-9a-fA-F]+){3,}$")).when(kind == "card", token.rlike("^[0-9 -]+$") & n.between(12, 19)).otherwise(token.rlike(r"^[+0-9() .-]+$") & n.between(7, 15))


def bootstrap(found: DataFrame) -> DataFrame:
    """Spans that only context finds: pii_key, kind, start, end."""
    clash = [F.exists(f"pii_{k}", lambda s: (s["start"] < F.col("t.end")) & (s["end"] > F.col("t.start"))) for k in KINDS]
    kind = reduce(lambda a, b: a.when(b[1], F.lit(b[0])), list(zip(KINDS, clash, strict=True))[1:], F.when(clash[0], F.lit(KINDS[0])))
    secret = F.arrays_overlap("t.beside", F.array(*[F.lit(f"{w} _") for w in SECRET_WORDS])) & mixed(F.col("t.m"))
    near = found.withColumn("t", F.explode("pii_tokens")).select("pii_key", "t.start", "t.end", F.col("t.m").alias("token"), "t.beside", kind.when(secret, F.lit(SECRET)).alias("kind"))
    near = stage(near, "near")
    own = near.where(F.col("kind") == SECRET).select("pii_key", "kind", "start", "end")
    beside = near.select("pii_key", "start", "end", "token", "kind", F.explode("beside").alias("pattern"))
    links = beside.groupBy("pattern", "token").agg(F.min("kind").alias("kind")).withColumn("score", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
    rise = 1.0
    while rise > SETTLED:
        links = stage(links, "links")
        confidence = links.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"))
        scored = links.join(stage(confidence, "patterns"), "pattern")
        best = stage(scored.groupBy("token").agg((DAMPING * F.max("confidence")).alias("best")), "instances")
        new = links.join(best, "token").withColumn("new", F.when(F.col("kind").isNotNull(), 1.0).otherwise(F.col("best"))).drop("best")
        rise = new.agg(F.max(F.col("new") - F.col("score"))).first()[0] or 0.0
        links = new.drop("score").withColumnRenamed("new", "score")
    every = [*KINDS, SECRET]
    trust = links.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("confidence"), F.count("kind").alias("seeds"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in every])
    trust = trust.where((F.col("confidence") >= CONFIDENT) & (F.col("seeds") >= LEAST_SEEDS)).select("pattern", F.coalesce(*[F.when(F.col(k) == F.greatest(*every), F.lit(k)) for k in every]).alias("like"))
    unseen = beside.where(F.col("kind").isNull()).join(stage(trust, "trusted"), "pattern").where(looks_like(F.col("like"), F.col("token")))
    found_by_context = unseen.groupBy("pii_key", "start", "end").agg(F.min("like").alias("kind")).select("pii_key", "kind", "start", "end")
    return own.unionByName(found_by_context).distinct()


def listed(kinds: dict[str, Column]) -> Column:
    def told(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[told(k, spans) for k, spans in kinds.items()]), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stage(found_in(table(spark, sf_dir, "documents").select("doc_id", "text")), "found")
    more = bootstrap(found).groupBy("pii_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))  # at most one for each token of a text
    both = found.drop("pii_tokens").join(stage(more, "more"), "pii_key", "left")
    place = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))
    bare = {k: F.transform(f"pii_{k}", place) for k in KINDS}
    context = F.coalesce("more", F.array().cast("array<struct<kind:string,start:int,end:int>>"))
    own = lambda k: F.transform(F.filter(context, lambda s: s["kind"] == k), place)
    every = {k: F.sort_array(F.concat(bare[k], own(k)) if k in bare else own(k)) for k in [*KINDS, SECRET]}
    n_found = F.size(context).cast("long")
    counts = {k: F.size(f"pii_{k}").cast("long") for k in KINDS}
    return both.select("doc_id", *[c.alias(f"n_{k}") for k, c in counts.items()], n_found.alias("n_found"), (reduce(Column.__add__, counts.values()) + n_found).alias("n_spans"), F.sha2(listed(bare), 256).alias("base_sha256"), listed(every).alias("spans"))
