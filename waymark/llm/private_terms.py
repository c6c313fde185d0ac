"""Operator 13: personal data and the terms that give it away, in expressions only.

Base spans (addresses of mail and hosts, card and phone numbers) are found by
patterns.  Their values are the protected entities.  Information-theoretic
sanitisation then asks which other terms reveal one: with ``D(x)`` the number of
different texts that hold ``x``, of ``N``, an entity ``e`` holds
``log(N / D(e))`` of information, and a term ``t`` that stands near it in ``j``
texts discloses ``log(N j / (D(e) D(t)))`` of it.  A term is revealing if that
is at least the share ``DISCLOSED`` of what there is to know, and it was seen
near the entity in ``LEAST_CONTEXTS`` different passages, so that copies of one
passage are no evidence.  Revealing terms become spans in the texts where they
stand near the entity, wherever in those texts they occur.

When a text is sanitised, a revealing term is generalised to the longest of its
beginnings (``PREFIXES`` characters and a ``*``) that reveals no entity that
the term reveals; where none is safe, it is removed.

Texts are cut by ``split`` and ``regexp_extract_all``, which see the same
matches; positions are sums of lengths, in chunks so that they cost little for
any number of matches.  Patterns are possessive, so long runs of letters or
digits take linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sifted, split_by, staged

# The kinds in the order of the digest, and what they look like.
# Each is the published pattern, written so that no match is tried from inside a run that failed.
_MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
#: A character that every match of the kind holds; texts without it are not searched.
MARK = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: The kind of the spans that the method adds.
TERM_KIND = "term"
TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"

#: Characters on either side of an entity, up to the next of its kind, that are near it.
CONTEXT = 64
LEAST_CONTEXTS, DISCLOSED = 3, 0.9
PREFIXES = (6, 3)
#: Lengths that are added up at a time.
CHUNK = 64
#: Characters of the blocks that a text is cut from.
BLOCK = 1000

SPAN = "array<struct<kind: string, start: long, end: long>>"


def running(sizes: Column) -> Column:
    """Sums of an array of lengths up to and with each place, chunk by chunk."""
    last = lambda a: F.element_at(a, -1)
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / CHUNK).cast("int")), lambda c: F.slice(sizes, c * CHUNK + 1, CHUNK))
    sums = lambda part: F.aggregate(part, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(last(a) + x)))
    inner = F.transform(chunks, sums)
    bases = F.aggregate(inner, F.array(F.lit(0).cast("long")), lambda a, part: F.concat(a, F.array(last(a) + last(part))))
    shifted = F.zip_with(inner, F.slice(bases, 1, F.size(bases) - 1), lambda part, base: F.transform(F.slice(part, 2, F.size(part) - 1), lambda x: x + base))
    return F.when(F.size(sizes) > 0, F.flatten(shifted)).otherwise(F.array().cast("array<long>"))


def found(df: DataFrame, text: str, pattern: str, name: str, able: Column | None = None) -> DataFrame:
    """``df`` with ``<name>_values, <name>_gaps, <name>_starts`` of the matches of a pattern.

    Gaps are what stands between matches, one more than these; starts count
    code points.  The pattern matches no empty string.
    """
    able = F.lit(True) if able is None else able
    values, gaps, starts = (f"{name}_{x}" for x in ("values", "gaps", "starts"))
    out = df.withColumn(values, F.when(able, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(gaps, F.when(F.size(values) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    steps = F.transform(values, lambda v, i: (F.char_length(F.get(gaps, i)) + F.when(i > 0, F.char_length(F.get(values, i - 1))).otherwise(0)).cast("long"))
    return out.withColumn(starts, running(steps))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass Luhn's sum; short strings of digits only."""
    twice = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the pattern is what it looks like."""
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.char_length(p) <= 3) & (F.coalesce(F.when(F.char_length(p) <= 3, p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        n = F.char_length(digits(value))
        return F.when(n.between(16, 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.char_length(digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array ``<kind>s(start, end, value, context)`` a kind.

    ``context`` is what stands within ``CONTEXT`` characters of the span on
    either side, up to the next match of the kind; words that the limit cuts
    are left out.
    """
    cut = rf"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
    out = docs
    for kind in KINDS:
        out = found(out, text, PATTERNS[kind], kind, F.contains(F.col(text), F.lit(MARK[kind])) if MARK[kind] else None)
        values, gaps, starts = (F.col(f"{kind}_{x}") for x in ("values", "gaps", "starts"))
        before = lambda g: F.when(F.char_length(g) > CONTEXT, F.regexp_replace(F.right(g, F.lit(CONTEXT)), f"^{cut}", "")).otherwise(g)  # noqa: B023, E731
        after = lambda g: F.when(F.char_length(g) > CONTEXT, F.regexp_replace(F.left(g, F.lit(CONTEXT)), f"{cut}$", "")).otherwise(g)  # noqa: B023, E731
        span = lambda s, i: F.struct(
            s.alias("start"), (s + F.char_length(F.get(values, i))).cast("long").alias("end"), F.get(values, i).alias("value"),  # noqa: B023
            F.concat_ws(" ", before(F.get(gaps, i)), after(F.get(gaps, i + 1))).alias("context"),  # noqa: B023
        )
        kept = F.filter(F.transform(starts, span), lambda x: holds(kind, x["value"]))  # noqa: B023
        out = out.withColumn(f"{kind}s", kept).drop(*(f"{kind}_{x}" for x in ("values", "gaps", "starts")))
    return out


def entity(kind: str, value: Column) -> Column:
    """What two spellings of one entity have in common."""
    return F.concat(F.lit(f"{kind}:"), F.lower(value) if kind == "email" else value if kind == "ip" else digits(value))


def folded(text: Column | str) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def forms(terms: str) -> Column:
    """Terms and their beginnings, ``abc*``, each once, of a column of distinct terms."""
    short = [F.transform(F.filter(terms, lambda t: F.char_length(t) > n), lambda t: F.concat(F.left(t, F.lit(n)), F.lit("*"))) for n in PREFIXES]  # noqa: B023
    return F.concat(F.col(terms), *map(F.array_distinct, short))


def terms_of(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded(text), F.lit(TERMS), F.lit(0)))


def mentions_of(spans: DataFrame) -> DataFrame:
    """``h, entity, seen, terms``: the passages around entities, one row each of a text.

    ``seen`` is a hash of the passage.  Other base spans in it are no terms.
    """
    every = F.flatten(F.array(*[F.transform(f"{k}s", lambda x: F.struct(entity(k, x["value"]).alias("entity"), x["context"].alias("context"))) for k in KINDS]))  # noqa: B023
    rows = spans.select("h", F.explode(every).alias("m")).select("h", "m.entity", "m.context").distinct()
    others = "|".join([*(f"(?:{PATTERNS[k]})" for k in ("email", "phone", "ip")), r"[0-9](?:[\x20-]?[0-9]){15,18}"])
    return rows.select("h", "entity", F.xxhash64("context").alias("seen"), terms_of(F.regexp_replace("context", others, " ")).alias("terms"))


def contexts(mentions: DataFrame) -> DataFrame:
    """``h, entity, c, form, seen``: what stands near entities of several texts (``c``)."""
    several = mentions.select("h", "entity").distinct().groupBy("entity").agg(F.count("*").alias("c")).where(F.col("c") >= 2)
    several = staged(several)  # an entity of one text cannot be seen in several
    kept = sifted(mentions, several.select(F.col("entity").alias("id")), "entity").join(several, "entity")
    return kept.select("h", "entity", "c", "seen", F.explode(forms("terms")).alias("form"))


def revealing(docs: DataFrame, n: int, mentions: DataFrame, near: DataFrame, share: float, least: int) -> DataFrame:
    """``entity, form``: forms that disclose at least ``share`` of an entity.

    ``docs`` holds ``h, text`` of all rows, ``n`` texts differ, ``near`` holds
    the rows of ``contexts``.  A form that stands near any entities in more
    texts than a revealing one is in at all is not counted in all texts.
    """
    # a pair's texts are counted from rows that are distinct first, so a frequent pair is spread
    texts = near.select("entity", "c", "form", "h").distinct().groupBy("entity", "c", "form").agg(F.count("*").alias("j")).where("j >= 2")
    passages = near.select("entity", "form", "seen").distinct().groupBy("entity", "form").agg(F.count("*").alias("p")).where(F.col("p") >= least)
    pairs = texts.join(passages, ["entity", "form"])
    # the most texts that a form of the pair may be in: D <= j (N / c) ** (1 - share)
    most = F.col("j") * F.pow(F.lit(float(n)) / F.col("c"), F.lit(1 - share)) * 1.000001
    around = mentions.select("h", F.explode(forms("terms")).alias("form")).distinct().groupBy("form").agg(F.count("*").alias("around"))
    pairs = staged(pairs.join(around, "form").where(F.col("around") <= most).drop("around"))
    asked = pairs.select(F.col("form").alias("id")).distinct()
    held = sifted(docs.select("h", terms_of("text").alias("terms")).select("h", F.explode(forms("terms")).alias("form")), asked, "form")
    spread = held.distinct().groupBy("form").agg(F.count("*").alias("d"))
    told = F.log2(F.lit(float(n)) * F.col("j") / (F.col("c") * F.col("d")))
    return pairs.join(spread, "form").where((told > 0) & (told >= share * F.log2(F.lit(float(n)) / F.col("c")))).select("entity", "form")


def term_spans(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """``h, terms``: spans and replacements of the terms ``hits(h, form, safe)`` of each text.

    ``docs`` holds ``h, text``; a text that many rows share is looked at once.
    """
    hit = hits.select(F.col("h").alias("hit_h"), F.col("form"), "safe")
    texts = sifted(docs, hits.select(F.col("h").alias("id")), "h").dropDuplicates(["h"])
    cut = found(texts, "text", TERMS, "term")
    pairs = F.arrays_zip(F.col("term_starts").alias("start"), F.col("term_values").alias("value"))
    each = cut.select("h", F.explode(pairs).alias("t")).select("h", F.col("t.start").alias("start"), F.col("t.value").alias("value"))
    joined = each.join(hit, (F.col("h") == F.col("hit_h")) & (folded("value") == F.col("form")))
    span = F.struct("start", (F.col("start") + F.char_length("value")).cast("long").alias("end"), "value", F.col("safe"))
    return joined.groupBy("h").agg(F.sort_array(F.collect_list(span)).alias("terms"))


def overlaps(x: Column, spans: Column) -> Column:
    return F.exists(spans, lambda s: (s["start"] < x["end"]) & (x["start"] < s["end"]))


def disclosures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = DISCLOSED, least: int = LEAST_CONTEXTS, keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, an array of spans a kind, and ``terms``.

    ``emails, ips, cards, phones`` hold ``start, end, value, context``,
    ``terms`` holds ``start, end, value, safe``: revealing terms outside of the
    base spans, and what may stand in their place (null: nothing).  Positions
    are code points, the end is exclusive.  Null and empty texts have no spans;
    equal texts have equal spans and count once; repeated rows and null ids
    come back as they are; ``keep`` names columns to carry along (in a struct
    ``row``); an empty table gives an empty result.  Texts are read whole, of
    any length.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(text.cast("binary")).alias("h"), text.alias("text"), *([F.struct(*keep).alias("row")] if keep else []))
    spans = staged(base_spans(rows).drop("text"))
    texts = rows.select("h", "text")
    mentions = staged(mentions_of(spans))
    near = staged(contexts(mentions))
    pairs = staged(revealing(texts, spans.select("h").distinct().count(), mentions, near, share, least))
    whole = pairs.where(~F.endswith(F.col("form"), F.lit("*")))
    # the longest beginning that reveals none of the text's entities near which the term stands
    seen = near.select("h", "entity", "form").distinct().join(whole, ["entity", "form"])
    safe = seen
    for n in PREFIXES:
        unsafe = pairs.select("entity", F.col("form").alias(f"p{n}"), F.lit(True).alias(f"bad{n}"))
        safe = safe.withColumn(f"p{n}", F.when(F.char_length("form") > n, F.concat(F.left("form", F.lit(n)), F.lit("*")))).join(unsafe, ["entity", f"p{n}"], "left")
    safe = safe.groupBy("h", "form").agg(*(F.when(F.count(f"bad{n}") == 0, F.first(f"p{n}")).alias(f"ok{n}") for n in PREFIXES))
    hits = staged(safe.select("h", "form", F.coalesce(*(f"ok{n}" for n in PREFIXES)).alias("safe")))
    added = staged(term_spans(texts, hits))
    maybe, sure = split_by(spans, added.select(F.col("h").alias("id")), "h")
    none = F.array().cast("array<struct<start: long, end: long, value: string, safe: string>>")
    base = F.concat(*(F.transform(f"{k}s", lambda x: F.struct(x["start"], x["end"])) for k in KINDS))
    joined = maybe.join(added, "h", "left").withColumn("terms", F.filter(F.coalesce("terms", none), lambda x: ~overlaps(x, base)))
    both = sure.withColumn("terms", none).unionByName(joined.select(*sure.columns, "terms"))
    return both.select(F.col("id").alias(id_col), *(f"{k}s" for k in KINDS), "terms", *(["row"] if keep else []))


def listed(kinds: list[str]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start."""
    one = lambda k: F.transform(f"{k}s", lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(F.concat(*map(one, kinds)), ",")


def digests(found_rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Id, ``n_<kind>`` of each base kind, ``base_sha256`` and ``spans`` of the rows of ``disclosures``."""
    counts = [F.size(f"{k}s").cast("long").alias(f"n_{k}") for k in KINDS]
    return found_rows.select(id_col, *counts, F.sha2(listed(KINDS).cast("binary"), 256).alias("base_sha256"), listed([*KINDS, TERM_KIND]).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Characters of a text that is given in blocks of ``BLOCK``."""
    first = F.floor(start / BLOCK).cast("int")
    few = F.array_join(F.slice(blocks, first + 1, F.greatest(F.floor((end - 1) / BLOCK).cast("int") - first + 1, F.lit(0))), "")
    return F.when(end > start, F.substring(few, (start % BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = DISCLOSED, least: int = LEAST_CONTEXTS) -> DataFrame:
    """``docs`` with sanitised texts, same columns.

    Base spans become ``[EMAIL]`` and the like, the first of those that
    overlap; revealing terms become their generalisation or go.  Null texts
    stay null.
    """
    rows = disclosures(docs, id_col, text_col, share, least, tuple(docs.columns))
    every = [F.transform(f"{k}s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("put"))) for k in KINDS]  # noqa: B023
    every.append(F.transform("terms", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.coalesce(x["safe"], F.lit("")).alias("put"))))
    marked = rows.withColumn("all", F.array_sort(F.concat(*every))).withColumn("text", F.coalesce(F.col("row")[text_col], F.lit("")))
    # spans that overlap an earlier one widen it
    reach = F.transform("all", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["put"].alias("put"), (x["start"] >= F.get("upto", i)).alias("new")))
    ends = F.transform("all", lambda x: x["end"])
    marked = marked.withColumn("upto", F.concat(F.array(F.lit(0).cast("long")), running_max(ends))).withColumn("all", reach)
    firsts = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.get("all", i)["new"])
    marked = marked.withColumn("firsts", F.when(F.size("all") > 0, firsts).otherwise(F.array().cast("array<int>")))
    marked = marked.withColumn("blocks", F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    # what stands before each merged span, what is put there, and the rest
    before = lambda i: piece(F.col("blocks"), F.get("upto", i), F.get("all", i)["start"])
    body = F.transform("firsts", lambda i: F.concat(before(i), F.get("all", i)["put"]))
    size = F.char_length("text").cast("long")
    rest = piece(F.col("blocks"), F.element_at("upto", -1), size)
    clean = F.when(F.size("firsts") > 0, F.concat(F.array_join(body, ""), rest)).otherwise(F.col("row")[text_col])
    return marked.withColumn("clean", clean).select(*(F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))


def running_max(values: Column) -> Column:
    """The largest up to and with each place, chunk by chunk."""
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    none = F.array().cast("array<long>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / CHUNK).cast("int")), lambda c: F.slice(values, c * CHUNK + 1, CHUNK))
    inner = F.transform(chunks, lambda part: F.aggregate(part, none, lambda a, x: F.concat(a, F.array(F.greatest(last(a), x)))))
    bases = F.aggregate(inner, F.array(F.lit(0).cast("long")), lambda a, part: F.concat(a, F.array(F.greatest(last(a), last(part)))))
    return F.when(F.size(values) > 0, F.flatten(F.zip_with(inner, F.slice(bases, 1, F.size(bases) - 1), lambda part, base: F.transform(part, lambda x: F.greatest(x, base))))).otherwise(none)
