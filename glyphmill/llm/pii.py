"""Personal data: fixed patterns, and bootstrapped extraction of what they miss, in DataFrame
expressions only.

What the fixed patterns find are the seeds. Candidates are sequences of neighbouring tokens that hold a
digit or an at sign (one to four tokens, or more that have CHARS characters together), and addresses with
their at sign spelled out. A candidate instance has lexical patterns of two views. The context view has
the words around a candidate that stands between words: the word before, the two words before, the word
after, the words before and after; whatever the candidate looks like, but apart for each kind whose
entities can be written in such characters at all. The form view has its shape (digits as 9, runs of
letters as a). Patterns and instances make a graph, and a round scores it both ways: a pattern by the
Wilson lower bound of the share of its distinct instances that are known as one kind, an instance by the
noisy-or of its confident patterns. Instances over the limit are known in the next round, so contexts of
seeds teach new shapes, and those shapes new contexts; rounds go on until none is new. Known candidates
that no fixed pattern has found and that touch no base span are added, longest first from the left.

Rounds work on distinct (pattern, instance) pairs with map-side combination, so a hot pattern or
instance is a few rows, and what is joined is written before, so that a hot key's partition can be
split; texts are read twice (spans, candidates) and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, running_starts
from .common import Scratch, discard, named, plain_text, written

#: The kinds in order, and their patterns. Possessive repeats and the looks behind leave
#: what is found as it is, and keep long runs linear.
KINDS = ("email", "ip", "card", "phone")
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: A candidate has so many tokens at most, or more that have so many characters together at most: an
#: account number has 34, a card or phone number fewer with its separators.
MAX_TOKENS, CHARS = 4, 40
#: Runs of candidate tokens; longer ones are read in pieces of so many tokens. The group has the tokens
#: after a piece in which candidates that start in the piece may end.
_NEXT = r"\x20(?=\S*[0-9@])\S++"
_RUN = rf"(?<!\S)(?=\S*[0-9@])\S++(?:{_NEXT}){{0,31}}+(?=((?:{_NEXT}){{0,{CHARS - 1}}}+))"
#: An at sign, and a dot, in words or brackets.
_AT, _DOT = r"\x20?[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]\x20?", r"(?:\.|\x20(?:dot|DOT)\x20|\x20?[(\[{]\x20?(?:dot|DOT|\.)\x20?[)\]}]\x20?)"
_SPELLED = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:{_AT}|\x20(?:at|AT)\x20(?=[A-Za-z0-9-]++(?!\.){_DOT}))[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)*+"
_MAY_SPELL = r"[(\[{]\x20?(?:at|AT|@)\x20?[)\]}]|\x20(?:at|AT)\x20[A-Za-z0-9-]++(?:\x20(?:dot|DOT)\x20|\x20?[(\[{])"
#: What entities of a kind are written in, whatever their layout: what they match and do not match, and
#: their least and most digits. A context vouches for nothing else.
ENTITIES = (
    (rf"@|{_AT}|\x20(?:dot|DOT)\x20", None, 0, None), (r"^\[?[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){2,}\]?$", None, 1, None),
    (r"^[A-Z0-9](?:[\x20-]?[A-Z0-9])*$", None, 12, 34), (r"^[+(]?[0-9][\x20()./0-9-]*$", r"^[0-9]+(?:\.[0-9]+){3}$", 7, 15),
)
#: Characters by which a word of a context is known: the last ones before a candidate, the first ones after.
WORD_CHARS = 40
#: What a pattern of the form and of the context view must reach, and an instance; distinct known
#: instances behind a pattern.
FORM_LIMIT, CONTEXT_LIMIT, INSTANCE_LIMIT, SUPPORT = 0.9, 0.6, 0.6, 8
#: Characters of a block of a text in which candidates and base spans meet.
_BLOCK = 64
#: Spans that _apart() handles at once.
_FOLD = 128

#: The end of a token that ends a phrase.
_STOP = r"[.,;:!?][\"')\]}>]*$"

_SPANS = "array<struct<start:int,end:int,said:string>>"


def spans_of(text: Column, pattern: str, when: Column, around: bool = False) -> Column:
    """array<struct<start, end, said>> of the leftmost non-overlapping matches, in code points: the
    pieces between matches and the matches in turn make up the text. around: with what stands before and
    after each match, as far as the beginning of the last match and the end of the next."""
    kind = _SPANS.replace("said:string", "said:string,before:string,after:string") if around else _SPANS

    def placed(said: Column) -> Column:
        def between(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, 1, F.size(said)), said, lambda b, m: F.length(b) + F.length(m))
            starts = F.zip_with(let(steps, running_starts), F.slice(pieces, 1, F.size(said)), lambda at, b: at + F.length(b))
            made = F.zip_with(starts, said, lambda at, m: F.struct(at.alias("start"), (at + F.length(m)).alias("end"), m.alias("said")))
            if not around:
                return made
            other = lambda i: F.coalesce(F.get(said, i), F.lit(""))
            return F.transform(
                made,
                lambda x, i: F.struct(
                    x["start"].alias("start"), x["end"].alias("end"), x["said"].alias("said"),
                    F.concat(other(i - 1), F.get(pieces, i)).alias("before"), F.concat(F.get(pieces, i + 1), other(i + 1)).alias("after"),
                ),
            )

        return let(F.split(text, pattern, -1), between)

    found = F.when(when, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return let(found, lambda said: F.when(F.size(said) > 0, placed(said)).otherwise(F.array().cast(kind)))


def _digits(said: Column) -> Column:
    return F.regexp_replace(said, "[^0-9]", "")


def _luhn(said: Column) -> Column:
    digits = F.split(F.reverse(_digits(said)), "")
    total = F.aggregate(
        F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)),
        F.lit(0), lambda a, x: a + x,
    )
    return total % 10 == 0


def base_spans(text: str) -> dict[str, Column]:
    """The span arrays of the four kinds for a text column."""
    t = F.col(text)
    has_digit = t.rlike("[0-9]")
    phone_digits = lambda s: F.length(_digits(s["said"]))
    return {
        "email": spans_of(t, EMAIL, t.contains("@")),
        "ip": F.filter(spans_of(t, IP, has_digit & t.rlike(r"[0-9]\.[0-9]")), lambda s: s["said"].rlike(rf"^{_IP_PART}(?:\.{_IP_PART}){{3}}$")),
        "card": F.filter(spans_of(t, CARD, has_digit), lambda s: _luhn(s["said"])),
        "phone": F.filter(spans_of(t, PHONE, has_digit & t.contains("+")), lambda s: (phone_digits(s) >= 8) & (phone_digits(s) <= 15)),
    }


def _tagged(spans: dict[str, Column]) -> Column:
    """All base spans as array<struct<k, start, end>>, by kind and start."""

    def of(i: int, k: str) -> Column:
        return F.transform(F.col(f"_{k}"), lambda s: F.struct(F.lit(i).alias("k"), s["start"].alias("start"), s["end"].alias("end")))

    return F.concat(*(of(i, k) for i, k in enumerate(spans)))


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["k"] + 1), s["start"], s["end"])), ",")


def _with_base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, tag, text, base): tag is the text's hash, which keeps rows apart that repeat an id."""
    rows = docs.select(named(id_col).alias("doc_id"), plain_text(text_col).alias("text")).withColumn("tag", F.xxhash64("text"))
    spans = base_spans("text")
    return rows.select("*", *(c.alias(f"_{k}") for k, c in spans.items())).withColumn("base", _tagged(spans)).drop(*(f"_{k}" for k in spans))


def form(said: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(said, r"\p{L}+", "a"), "[0-9]", "9")


def _known_by(word: Column) -> Column:
    """A word before a candidate as patterns have it: in its form where it is itself a candidate token."""
    end = F.right(word, F.lit(WORD_CHARS))
    return F.lower(F.when(end.rlike("[0-9@]"), form(end)).otherwise(end))


def _following(after: Column) -> Column:
    """The word after a candidate, the mark that ends its phrase, or that the text ends."""
    first = F.regexp_extract(after, rf"^\s*+(\S{{1,{WORD_CHARS}}})", 1)
    return F.lower(F.when(first == "", F.lit("$")).when(first.rlike("[0-9@]"), form(first)).otherwise(F.regexp_replace(first, r"(?<=.)[.,;:!?\"')\]}>]++$", "")))


_BEFORE = r"(?<!\S)(?:(\S++)\s++)?(\S++)\s++$"


def _windows(rows: DataFrame) -> DataFrame:
    """The sequences of candidate tokens: doc_id, tag, start, end, said, left2, left, right, whole. whole:
    between a word without digits and the end of the run or of the phrase."""
    t = F.col("text")
    pieces = F.zip_with(
        spans_of(t, _RUN, F.lit(True), True), F.regexp_extract_all(t, F.lit(_RUN), F.lit(1)),
        lambda x, more: F.struct(x["start"].alias("start"), x["said"].alias("said"), x["before"].alias("before"), x["after"].alias("after"), more.alias("more")),
    )
    runs = rows.where(t.rlike("[0-9@]")).select("doc_id", "tag", F.explode(pieces).alias("run"))
    tokens = F.split(F.concat("run.said", "run.more"), " ")
    several = runs.select(
        "doc_id", "tag", tokens.alias("tokens"), let(F.transform(tokens, lambda x: F.length(x) + 1), running_starts).alias("starts"), F.col("run.start").alias("at"),
        F.size(F.split("run.said", " ")).alias("own"), F.regexp_extract("run.before", _BEFORE, 2).alias("before"), F.regexp_extract("run.before", _BEFORE, 1).alias("before2"),
        F.when(F.col("run.more") == "", _following(F.col("run.after"))).otherwise(F.lit("9")).alias("after"),
    )
    reach = F.aggregate(
        F.slice("tokens", F.col("i"), CHARS),
        F.struct(F.lit(0).alias("chars"), F.lit(0).alias("m"), F.lit(0).alias("phrase"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(
            (acc["chars"] + F.length(x)).alias("chars"), (acc["m"] + (acc["chars"] + F.length(x) <= CHARS).cast("int")).alias("m"),
            F.when((acc["phrase"] == 0) & x.rlike(_STOP), acc["at"] + 1).otherwise(acc["phrase"]).alias("phrase"), (acc["at"] + 1).alias("at"),
        ),
    )
    n = F.size("tokens")
    firsts = several.withColumn("i", F.explode(F.sequence(F.lit(1), "own"))).withColumn("reach", reach)
    phrase = F.when(F.col("reach.phrase") > 0, F.col("reach.phrase")).otherwise(n - F.col("i") + 1)
    each = firsts.withColumn("phrase", phrase).withColumn("m", F.explode(F.sequence(F.lit(1), F.greatest(F.least(F.lit(MAX_TOKENS), n - F.col("i") + 1), "reach.m"))))
    token = lambda i: F.get("tokens", i - 1)  # noqa: E731  counted from 1, null outside
    last = F.col("i") + F.col("m")
    cut = each.select(
        "doc_id", "tag", F.array_join(F.slice("tokens", F.col("i"), F.col("m")), " ").alias("full"), (F.col("at") + F.get("starts", F.col("i") - 1)).alias("at"),
        _known_by(F.when(F.col("i") > 1, token(F.col("i") - 1)).otherwise(F.col("before"))).alias("left"),
        _known_by(F.when(F.col("i") > 2, token(F.col("i") - 2)).when(F.col("i") == 2, F.col("before")).otherwise(F.col("before2"))).alias("left2"),
        F.when(last <= n, form(F.substring(token(last), 1, WORD_CHARS))).otherwise(F.col("after")).alias("right"), (F.col("m") == F.col("phrase")).alias("phrase"),
    )
    lead = F.length(F.regexp_extract("full", r"^[\"'(\[<{]*", 0))
    said = F.regexp_replace(F.regexp_replace("full", r"^[\"'(\[<{]+", ""), r"[\"'.,;:!?)\]>}]+$", "")
    stop = F.regexp_extract("full", r"([.,;:!?])[\"')\]}>]*$", 1)
    return cut.select(
        "doc_id", "tag", (F.col("at") + lead).alias("start"), said.alias("said"), "left2", "left", F.when(stop != "", stop).otherwise(F.col("right")).alias("right"),
        (F.col("phrase") & F.col("left").rlike(r"^\D*\p{L}\D*$")).alias("whole"),
    ).where("said <> ''").withColumn("end", F.col("start") + F.length("said"))


def _spelled(rows: DataFrame) -> DataFrame:
    """The addresses with their at sign spelled out, as _windows() has its sequences."""
    t = F.col("text")
    found = rows.where(t.rlike(_MAY_SPELL)).select("doc_id", "tag", F.explode(spans_of(t, _SPELLED, F.lit(True), True)).alias("x"))
    return found.select(
        "doc_id", "tag", "x.start", "x.said", _known_by(F.regexp_extract("x.before", _BEFORE, 1)).alias("left2"), _known_by(F.regexp_extract("x.before", _BEFORE, 2)).alias("left"),
        _following(F.col("x.after")).alias("right"), F.lit(True).alias("whole"), "x.end",
    )


def _in_blocks(spans: DataFrame) -> DataFrame:
    return spans.withColumn("block", F.explode(F.sequence((F.col("start") / _BLOCK).cast("int"), ((F.col("end") - 1) / _BLOCK).cast("int"))))


def candidates(rows: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, tag, start, end, said, left2, left, right, whole, kind), each once: kind is that of the
    base span with the same bounds, null for candidates that touch none."""
    found = (Scratch() if scratch is None else scratch).written(_windows(rows).unionByName(_spelled(rows)).distinct(), "pii-windows")
    spans = rows.where(F.size("base") > 0).select("doc_id", "tag", F.inline("base")).distinct()
    one = found.select(F.col("doc_id").alias("d"), F.col("tag").alias("t"), "start", "end").distinct()
    b = _in_blocks(spans).select(*(F.col(c).alias(f"b_{c}") for c in ("doc_id", "tag", "block", "start", "end", "k")))
    at = (F.col("d").eqNullSafe(F.col("b_doc_id"))) & (F.col("t") == F.col("b_tag")) & (F.col("block") == F.col("b_block"))
    met = _in_blocks(one).join(b, at & (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))
    same = (F.col("start") == F.col("b_start")) & (F.col("end") == F.col("b_end"))
    told = met.groupBy("d", "t", F.col("start").alias("s"), F.col("end").alias("e")).agg(F.min(F.when(same, F.col("b_k"))).alias("kind"))
    joined = found.join(told, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")) & (F.col("start") == F.col("s")) & (F.col("end") == F.col("e")), "left")
    return joined.where(F.col("t").isNull() | F.col("kind").isNotNull()).drop("d", "t", "s", "e")


def _wilson(hits: Column, n: Column, z: float = 1.96) -> Column:
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n)) / (1 + z * z / n)


def patterns(found: DataFrame) -> DataFrame:
    """(pattern, said, seed) of the candidates, each pair once; seed is the kind that the fixed patterns
    give the instance, null for others."""
    said, digits = F.col("said"), F.length(_digits(F.col("said")))
    fits = [said.rlike(p) & (~said.rlike(but) if but else F.lit(True)) & (digits >= least) & (digits <= most if most else F.lit(True)) for p, but, least, most in ENTITIES]
    around = (("left", "left"), ("left2", "left2", "left"), ("right", "right"), ("both", "left", "right"))
    context = F.array(*(F.when(F.col("whole") & fit, F.concat_ws(" ", F.lit(name), F.lit(k), *words)) for k, fit in zip(KINDS, fits, strict=True) for name, *words in around))
    both = F.concat(F.array(F.concat(F.lit("form "), form(said))), F.array_compact(context))
    return found.select("said", "kind", F.explode(both).alias("pattern")).groupBy("pattern", "said").agg(F.min("kind").alias("seed"))


def bootstrap(found: DataFrame) -> DataFrame:
    """(said, kind) of all known instances: seeds, and those that confident patterns vouch for. Ties
    between kinds go to the first; who is known stays so, so the rounds end."""
    spark = found.sparkSession
    pairs, graph = written(patterns(found), "pii-graph")
    known, _ = written(pairs.where("seed is not null").groupBy("said").agg(F.min("seed").alias("kind")), "pii-known")
    kinds = range(len(KINDS))
    while True:
        votes = pairs.join(known, "said", "left").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in kinds))
        hits = F.greatest(*(F.col(f"k{k}") for k in kinds))
        which = F.coalesce(*(F.when(F.col(f"k{k}") == hits, F.lit(k)) for k in kinds))
        limit = F.when(F.col("pattern").startswith("form "), FORM_LIMIT).otherwise(CONTEXT_LIMIT)
        confident, used = written(votes.select("pattern", which.alias("vote"), _wilson(hits, F.col("n")).alias("worth")).where((hits >= SUPPORT) & (F.col("worth") >= limit)), "pii-confident")
        doubt = F.sum(F.log(F.greatest(1 - F.col("worth"), F.lit(1e-9))))
        scored = pairs.join(confident, "pattern").groupBy("said", "vote").agg((1 - F.exp(doubt)).alias("score")).where(F.col("score") >= INSTANCE_LIMIT)
        best = scored.groupBy("said").agg((-F.max(F.struct(F.round("score", 9).alias("score"), (-F.col("vote")).alias("vote")))["vote"]).cast("int").alias("kind"))
        new, _ = written(best.join(known, "said", "left_anti"), "pii-new")
        discard(spark, used)
        if new.isEmpty():
            discard(spark, graph)
            return known
        known = known.unionByName(new)


def _apart(spans: Column) -> Column:
    """Spans of array<struct<start, end, k>>, longest first at each start, without those that overlap an
    earlier one. They are folded in pieces, as an array that grows by one is copied each time."""
    ordered = F.array_sort(
        spans,
        lambda a, b: F.when(a["start"] != b["start"], F.signum((a["start"] - b["start"]).cast("double")).cast("int")).otherwise(F.signum((b["end"] - a["end"]).cast("double")).cast("int")),
    )
    kind = "array<struct<k:int,start:int,end:int>>"

    def add(acc: Column, s: Column) -> Column:
        own = F.array(F.struct(s["k"].alias("k"), s["start"].alias("start"), s["end"].alias("end")))
        return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], own).alias("out"))).otherwise(acc)

    def piece(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("out")), add)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def folded(xs: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / _FOLD).cast("int")), lambda i: F.slice(xs, i * _FOLD + 1, F.lit(_FOLD)))
        return F.flatten(F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{kind}>").alias("out")), piece, lambda acc: acc["out"]))

    return let(ordered, folded)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, n_added, base_sha256, spans.

    The counts and base_sha256 are of the fixed patterns; spans has all spans, added ones under their
    kind, as kind:start:end in code points by kind and then start. Base spans of different kinds may
    overlap; an added one overlaps none. Null text counts as empty and has no spans. Texts are read
    whole; repeated rows repeat their result and count once as instances; other columns are ignored.
    An empty table gives an empty result.
    """
    rows = _with_base(docs, id_col, text_col)
    scratch = Scratch()
    found, _ = written(candidates(rows, scratch), "pii-candidates")
    scratch.clear_from(docs.sparkSession)
    vouched = bootstrap(found).select("said", F.col("kind").alias("k"))
    added = (
        found.where("kind is null")
        .select("doc_id", "tag", "start", "end", "said")
        .distinct()
        .join(vouched, "said")
        .groupBy("doc_id", "tag")
        .agg(_apart(F.collect_set(F.struct("start", "end", "k"))).alias("added"))
        .select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), "added")
    )

    def n(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")

    told = rows.select("doc_id", "tag", "base", *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"))
    more = F.coalesce(F.col("added"), F.array().cast("array<struct<k:int,start:int,end:int>>"))
    return told.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.size(more).cast("long").alias("n_added"), "base_sha256",
        _joined(F.array_sort(F.concat("base", more))).alias("spans"),
    )
