"""Personal data by patterns, widened by bootstrapped contexts. DataFrame functions only.

Four base kinds are found by their forms. They are the seeds of a graph between
instances and the lexical patterns around them (the word before). Words with digits or an
at sign that follow each other by a single space are a run; a run is cut at base matches,
and each base match and each part between them is an instance that goes by the word before
the run. A pattern's score is the weight of the instances it precedes over all its
occurrences in the corpus; a run weighs once, by its first base match or else its first
part. An instance's score is the chance that at least one confident pattern means it.
Rounds of the two spread confidence from the seeds until no pattern becomes confident and
no score rises any more, and instances of confident patterns are reported as ``context``.

Defined cases: null and empty texts have no findings; a null id is kept; repeated
rows get the same findings each and count each time; empty tables give empty
results. Only the named columns are read. Counts are over all rows, copies included;
context spans that a base span overlaps are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trapline.llm import common
from trapline.session import materialise

KINDS = ("email", "ip", "card", "phone")
SETTLED = 1e-9
#: Private code points: what stands for the characters of base matches where runs are cut, and what parts a text at its matches.
_PLAIN = "".join(map(chr, range(0x20, 0x7F)))
_MARKED = "".join(chr(0xE000 + ord(c)) for c in _PLAIN)
_PART = "\ue000"
_MARK = f"{_MARKED[0]}-{_MARKED[-1]}"


def _one_of(*members: str, marked: bool) -> str:
    """One of some characters and ``az`` ranges, or what stands for them."""
    both = [*members, *["".join(chr(0xE000 + ord(c)) for c in m) for m in members if marked]]
    return "[" + "".join(f"{m[0]}-{m[1]}" if len(m) == 2 else f"\\{m}" for m in both) + "]"


def _forms(marked: bool) -> dict[str, str]:
    digit, dot, dash = _one_of("09", marked=marked), _one_of(".", marked=marked), _one_of(" ", "-", marked=marked)
    name = _one_of("AZ", "az", "09", ".", "_", "%", "+", "-", marked=marked)
    host = _one_of("AZ", "az", "09", "-", marked=marked)
    return {
        # A run of name characters is tried from its beginning, or from where the last match ended, and never given back.
        "email": rf"(?:\G|(?<!{name})){name}++{_one_of('@', marked=marked)}{host}+(?:{dot}{host}+)++",
        "ip": rf"(?<!{digit}){digit}++(?:{dot}{digit}++){{3}}",
        # Whole runs of 16 to 19 digits: no other run can hold a card.
        "card": rf"(?<!{digit})(?<!{digit}{dash}){digit}(?:{dash}?{digit}){{15,18}}(?!{dash}?{digit})",
        "phone": rf"{_one_of('+', marked=marked)}{digit}{_one_of(' ', '(', ')', '.', '09', '-', marked=marked)}+{digit}",
    }


PATTERNS, _MARKED_PATTERNS = _forms(False), _forms(True)
#: A text without this character has no match of the kind.
_SIGNS = {"email": "@", "phone": "+"}
#: Words that hold a digit or an at sign, and all such words that follow directly, outside base matches.
_WORD = rf"[^\s0-9@{_MARK}]*+[0-9@][^\s{_MARK}]*+"
INSTANCE = rf"[{_MARK}]++|(?<![^\s{_MARK}]){_WORD}(?:\x20{_WORD})*+"
#: The same for a text without base matches.
_WHOLE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+(?:\x20[^\s0-9@]*+[0-9@]\S*+)*+"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    value = F.transform(each, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(value, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: Column, match: Column) -> Column:
    digits = _digits(match)
    n = F.length(digits)
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return (F.when(kind == "card", F.when(n.between(16, 19), _luhn(digits)).otherwise(False))
            .when(kind == "phone", n.between(8, 15))
            .when(kind == "ip", match.rlike(rf"^{part}(?:\.{part}){{3}}$"))
            .otherwise(True))


def _placed(marks: DataFrame, keys: list[str]) -> DataFrame:
    """Begin and end of each mark, from rows ``i, p`` of one text and kind."""
    upto = F.sum(F.col("p.gap") + F.coalesce("p.size", F.lit(0))).over(Window.partitionBy(*keys).orderBy("i"))
    return marks.withColumn("end", upto.cast("int")).withColumn("begin", F.col("end") - F.col("p.size"))


def _plain(word: Column) -> Column:
    """A word without marks around it, in lower case."""
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]++|[^\p{L}\p{N}]++$", ""))


def _parted(text: Column, pattern: str) -> Column:
    """The text cut at its matches, which stand at every second place."""
    return F.split(F.regexp_replace(text, pattern, f"{_PART}$0{_PART}"), _PART)


def _each_match(parts: Column, mark) -> Column:
    """``mark(gap, match, last)`` for each match, the text before it and the match before that; null without matches."""
    places = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
    return F.when(F.size(parts) > 1, F.transform(places, lambda i: mark(parts[i - 1], parts[i], F.when(i > 1, F.get(parts, i - 2)))))


def _base_mark(kind: str):
    """Lengths of a match and of the gap before it, and whether the match counts; the texts stay behind."""
    return lambda gap, match, last: F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), _valid(F.lit(kind), match).alias("told"))


def _is_marked(part: Column) -> Column:
    return F.left(part, F.lit(1)).between(_MARKED[0], _MARKED[-1])


def _unmarked(part: Column) -> Column:
    return F.when(_is_marked(part), F.translate(part, _MARKED, _PLAIN)).otherwise(part)


def _marked(text: Column, kind: str) -> Column:
    """The text with the matches of a kind that count in marked characters; some may be marked already."""
    def part(p, i):
        return F.when((i % 2 == 1) & _valid(F.lit(kind), F.translate(p, _MARKED, _PLAIN)), F.translate(p, _PLAIN, _MARKED)).otherwise(p)

    return F.array_join(F.transform(_parted(text, _MARKED_PATTERNS[kind]), part), "")


def _any_marked(text: Column, kind: Column) -> Column:
    """``_marked`` for a kind that is known by row only."""
    out = text
    for k in KINDS:
        out = F.when(kind == k, _marked(text, k)).otherwise(out)
    return out


def _run_mark(gap: Column, match: Column, last: Column) -> Column:
    """A base match, or a part of a run, and the word before the run as it stands.

    ``joined`` parts lie in the run of the part before, ``last``.
    """
    seed = _is_marked(match)
    head = F.when(seed, 0).otherwise(F.length(F.regexp_extract(match, r"^[^\p{L}\p{N}+(@]*+", 0)))
    joined = last.isNotNull() & gap.rlike(r"^\S*+\x20?+\S*+\z")
    # Read from its end, the text before the match begins with what touches the match, then comes the word before.
    back = F.reverse(F.concat(F.coalesce(_unmarked(last), F.lit("")), gap))
    before = F.when(~joined, F.reverse(F.regexp_extract(back, r"^\S*+\s++(\S++)", 1)))
    return F.struct(F.length(gap).alias("gap"), F.length(match).alias("size"), match.alias("match"), head.alias("head"),
                    before.alias("before"), seed.alias("seed"), joined.alias("joined"))


def _instance_mark(p: Column) -> Column:
    """The same with the match as an instance, without marks around it, and the word before as a pattern."""
    core = F.when(p["seed"], F.translate(p["match"], _MARKED, _PLAIN)).otherwise(
        F.regexp_replace(F.substr(p["match"], p["head"] + 1), r"[^\p{L}\p{N}]++$", ""))
    return F.struct(p["gap"].alias("gap"), p["size"].alias("size"), p["head"].alias("head"), F.nullif(core, F.lit("")).alias("instance"),
                    _plain(p["before"]).alias("pattern"), p["seed"].alias("seed"), p["joined"].alias("joined"))


def _once(rows: DataFrame, *columns: Column | str) -> DataFrame:
    """The columns, evaluated once here: neither filters nor later columns are merged with them across a generator."""
    named = [F.col(c) if isinstance(c, str) else c for c in columns]
    return rows.select(F.explode(F.array(F.struct(*named))).alias("row")).select("row.*")


def marks(documents: DataFrame, text: Column) -> DataFrame:
    """``tid, n`` and the marks of every kind, for each different text that has any; ``n`` counts its copies.

    Marks hold lengths and identifiers, so no text is shuffled; copies combine before the shuffle.
    """
    own = F.when(text.rlike(f"[{_PART}{_MARK}]"), F.regexp_replace(text, f"[{_PART}{_MARK}]", "\ufffd")).otherwise(text)
    found = _once(documents, common.digest(text).alias("tid"), own.alias("text"))

    def base(kind: str) -> Column:
        parts = _parted(F.col("text"), PATTERNS[kind])
        return (F.when(F.col("text").contains(_SIGNS[kind]), parts) if kind in _SIGNS else parts).alias(kind)

    found = _once(found, "tid", "text", *[base(k) for k in KINDS])
    found = _once(found, "tid", "text", *[_each_match(F.col(k), _base_mark(k)).alias(k) for k in KINDS])
    # A kind without one match that counts is left out before any row is made.
    some = _once(found, "tid", "text", *[F.when(F.exists(k, lambda p: p["told"]), F.col(k)).alias(k) for k in KINDS])
    kinds = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in KINDS]))
    cut = F.when(F.size(kinds) > 0, F.aggregate(kinds, F.col("text"), _any_marked))
    parts = _once(some, "tid", *KINDS, "text", cut.alias("cut"))
    parts = _once(parts, "tid", *KINDS, F.when(F.col("cut").isNull(), _parted(F.col("text"), _WHOLE)).otherwise(
        _parted(F.col("cut"), INSTANCE)).alias("parts"))
    parts = _once(parts, "tid", *KINDS, _each_match(F.col("parts"), _run_mark).alias("context"))
    parts = _once(parts, "tid", *KINDS, F.transform("context", _instance_mark).alias("context"))
    names = [*KINDS, "context"]
    return (parts.where(F.greatest(*[F.col(k).isNotNull() for k in names]))
            .groupBy("tid").agg(F.count("*").alias("n"), F.first(F.struct(*names)).alias("m")).select("tid", "n", "m.*"))


def base_spans(marked: DataFrame) -> DataFrame:
    """``tid, kind, begin, end`` of the base kinds."""
    each = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("parts")) for k in KINDS])
    rows = marked.select("tid", F.explode(each).alias("x")).select("tid", "x.kind", F.posexplode("x.parts").alias("i", "p"))
    return _placed(rows, ["tid", "kind"]).where("p.told").select("tid", "kind", "begin", "end")


def instances(marked: DataFrame) -> DataFrame:
    """``tid, n, begin, end, instance, pattern, seed, weight`` of every base match and other part of a run with a word before.

    ``weight`` is ``n`` for the part that its run weighs by, else 0.
    """
    placed = _placed(marked.select("tid", "n", F.posexplode("context").alias("i", "p")), ["tid"])
    placed = placed.withColumn("run", F.sum((~F.col("p.joined")).cast("int")).over(Window.partitionBy("tid").orderBy("i")))
    run = Window.partitionBy("tid", "run").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = F.col("p.instance").isNotNull()
    begin = F.col("begin") + F.col("p.head")
    return placed.select(
        "tid", "n", begin.alias("begin"), (begin + F.length("p.instance")).alias("end"), "p.instance", "p.seed",
        F.first("p.pattern").over(run).alias("pattern"),
        F.coalesce(F.min(F.when(F.col("p.seed"), F.col("i"))).over(run), F.min(F.when(told, F.col("i"))).over(run)).alias("weighs"), "i",
    ).where(F.col("instance").isNotNull() & (F.col("pattern") != "")).select(
        "tid", "n", "begin", "end", "instance", "pattern", "seed", F.when(F.col("i") == F.col("weighs"), F.col("n")).otherwise(0).alias("weight"))


def occurrences(documents: DataFrame, text: Column) -> DataFrame:
    """``pattern, total``: how often each word occurs. Words are counted as they stand before they are stripped."""
    words = documents.select(F.explode(F.split(text, r"\s+")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return words.groupBy(_plain(F.col("word")).alias("pattern")).agg(F.sum("n").alias("total")).where(F.col("pattern") != "")


def context_spans(marked: DataFrame, words: DataFrame, *, least_instances: int = 5, least_score: float = 0.8) -> DataFrame:
    """``tid, begin, end`` of instances that confident patterns precede.

    A pattern needs ``least_instances`` different instances and ``least_score`` to count. Scores only rise from
    round to round; the rounds end when no pattern becomes confident and no confidence rises by ``SETTLED``.
    """
    found = materialise(instances(marked), "instances")
    edges = found.groupBy("pattern", "instance").agg(F.sum("weight").alias("n"), F.max("seed").alias("seed"))
    # A pattern that mostly precedes no instance stays below the score even if all its instances are sure.
    known = (edges.groupBy("pattern").agg(F.count_if(F.col("n") > 0).alias("m"), F.sum("n").alias("most")).where(F.col("m") >= least_instances)
             .join(words, "pattern").where(F.col("most") / F.col("total") >= least_score).select("pattern", "total"))
    edges = materialise(edges.join(known, "pattern"), "edges")
    score = F.when(F.col("seed"), 1.0).otherwise(F.coalesce("chance", F.lit(0.0)))
    meant, reached = None, (0, 0.0)
    while True:
        scored = edges.withColumn("chance", F.lit(0.0)) if meant is None else edges.join(meant, "instance", "left")
        patterns = (scored.groupBy("pattern").agg((F.sum(F.col("n") * score) / F.max("total")).alias("confidence"))
                    .where(F.col("confidence") >= least_score).withColumn("confidence", F.least("confidence", F.lit(0.999))))
        patterns = materialise(patterns, "patterns")
        now = tuple(patterns.agg(F.count("*"), F.coalesce(F.sum("confidence"), F.lit(0.0))).first())
        if now[0] == reached[0] and now[1] - reached[1] < SETTLED:
            break
        reached = now
        meant = materialise(edges.where(~F.col("seed")).join(patterns, "pattern").groupBy("instance")
                            .agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("chance")), "meant")
    if meant is None:
        return found.select("tid", "begin", "end").limit(0)
    sure = meant.where(F.col("chance") >= least_score).select("instance")
    return found.where(~F.col("seed")).join(sure, "instance", "left_semi").select("tid", "begin", "end")


def find(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``id, base, spans``: arrays of ``(kind, begin, end)``, by kind as listed, then begin; context spans come last."""
    text = common.text_of(text_col)
    rows = documents.select(F.col(id_col).alias("id"), common.digest(text).alias("tid"))
    marked = materialise(marks(documents, text), "marks")
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    grouped = base_spans(marked).groupBy("tid").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "begin", "end", "kind"))).alias("base"))
    extra = context_spans(marked, occurrences(documents, text), **options)
    context = extra.groupBy("tid").agg(F.sort_array(F.collect_list(
        F.struct(F.lit(len(KINDS) + 1).alias("place"), "begin", "end", F.lit("context").alias("kind")))).alias("context"))
    none = F.array().cast("array<struct<place:int,begin:int,end:int,kind:string>>")
    both = rows.join(grouped, "tid", "left").join(context, "tid", "left").select(
        "id", F.coalesce("base", none).alias("base"), F.coalesce("context", none).alias("context"))
    apart = F.filter("context", lambda c: ~F.exists("base", lambda b: (b["begin"] < c["end"]) & (c["begin"] < b["end"])))
    return both.select("id", "base", F.concat("base", apart).alias("spans"))
