"""Queries: text normalisation, answer scores, evidence, verdicts, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.functions import text as x
from waymark.operators import containment
from waymark.plans import tables as t
from waymark.plans.registry import query, rounded


def norm(column: str) -> str:
    """SQL of ``normalize_answer``: words between white space, articles dropped."""
    bare = rf"regexp_replace(lower({column}), '[!-/:-@\[-`{{-~]', '', 'g')"
    return rf"array_to_string(list_filter(regexp_split_to_array({bare}, '[\s\x1c-\x1f\x85\xa0]+'), lambda w: w NOT IN ('', 'a', 'an', 'the')), ' ')"


@query("normalize_answer", f"SELECT doc_id, sha256({norm('text')}) AS normalized_sha256 FROM documents")
def normalize_answer(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", F.sha2(x.normalize_answer("text"), 256).alias("normalized_sha256"))


@query("normalize_question", r"SELECT doc_id, sha256(trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g'))) AS normalized_sha256 FROM documents")
def normalize_question(spark, sf_dir):
    return t.read(spark, sf_dir, "documents").select("doc_id", F.sha2(x.normalize_question("text"), 256).alias("normalized_sha256"))


GOLDS = "[concat('The ', upper(p_name), '!'), p_type]"


def _parts(spark, sf_dir):
    """Predictions and golds: names against a disguised name and a type."""
    p = t.read(spark, sf_dir, "part")
    pred = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.concat_ws(" ", F.lit("a"), F.element_at(F.split("p_name", " "), 1), "p_brand"))
    golds = F.array(F.concat(F.lit("The "), F.upper("p_name"), F.lit("!")), F.col("p_type"))
    return p.select("p_partkey", pred.alias("pred"), golds.alias("golds"))


PARTS = f"parts AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN p_name ELSE concat_ws(' ', 'a', split_part(p_name, ' ', 1), p_brand) END AS pred, {GOLDS} AS golds FROM part)"


@query("official_em", f"WITH {PARTS} SELECT p_partkey, CAST(list_contains([{norm('g')} FOR g IN golds], {norm('pred')}) AS INT) AS em FROM parts")
def official_em(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", x.official_em("pred", "golds").alias("em"))


@query("strict_em", f"WITH {PARTS} SELECT p_partkey, CAST(list_contains([trim(g) FOR g IN golds], trim(pred)) AS INT) AS em FROM parts")
def strict_em(spark, sf_dir):
    return _parts(spark, sf_dir).select("p_partkey", x.strict_em("pred", "golds").alias("em"))


@query(
    "token_f1",
    f"""WITH {PARTS}, k AS (SELECT p_partkey, {norm('pred')} AS p, unnest([{norm('g')} FOR g IN golds]) AS g FROM parts), s AS (SELECT p_partkey, string_split(p, ' ') AS p, string_split(g, ' ') AS g FROM k),
f AS (SELECT p_partkey, len(p) AS np, len(g) AS ng, CAST(list_sum([least(len(list_filter(p, lambda y: y = w)), len(list_filter(g, lambda y: y = w))) FOR w IN list_distinct(p)]) AS BIGINT) AS c FROM s)
SELECT p_partkey, round(max(CASE WHEN c > 0 THEN 2.0::DOUBLE * c / (np + ng) ELSE 0 END), 9) AS f1 FROM f GROUP BY p_partkey""",
)
def token_f1(spark, sf_dir):
    return rounded(_parts(spark, sf_dir).select("p_partkey", x.token_f1("pred", "golds").alias("f1")))


@query("evidence_blocks", r"""WITH b AS (SELECT page_id, [trim(p, ' ' || chr(9) || chr(10) || chr(13)) FOR p IN [string_split(string_split(y, '</p>')[1], '</article>')[1] FOR y IN string_split(html, '<p>')[2:]] IF trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> ''] AS b FROM pages)
SELECT page_id, sha256(CASE WHEN len(b) > 0 THEN array_to_string(b, chr(10) || chr(10)) ELSE '[NO RETRIEVED EVIDENCE]' END) AS evidence_sha256, CAST(len(b) AS BIGINT) AS n_blocks FROM b""")
def evidence_blocks(spark, sf_dir):
    e = x.extract_evidence(F.col("html"), "<p>", ("</p>", "</article>"), after=None)
    return t.read(spark, sf_dir, "pages").withColumn("e", e).select("page_id", F.sha2("e.evidence", 256).alias("evidence_sha256"), "e.n_blocks")


@query("observation_information", "SELECT page_id, sha256(trim(regexp_extract(html, '<h1>((?s:.*?))</h1>', 1), ' ' || chr(9) || chr(10) || chr(13))) AS block_sha256 FROM pages")
def observation_information(spark, sf_dir):
    return t.read(spark, sf_dir, "pages").select("page_id", F.sha2(x.observation_information("html", "<h1>", "</h1>"), 256).alias("block_sha256"))


@query("render_user_text", t.sql("SELECT question_id, state_index, sha256('EVIDENCE RETRIEVED SO FAR:' || chr(10) || CAST(event_id AS VARCHAR) || chr(10) || chr(10) || 'QUESTION:' || chr(10) || next_action || chr(10) || chr(10) || 'SEARCHES_USED: ' || CAST(state_index AS VARCHAR) || chr(10) || 'REMAINING_SEARCH_BUDGET: ' || CAST(greatest(0, 4 - state_index) AS VARCHAR) || chr(10) || chr(10) || 'Output exactly one action: STOP or CONTINUE.') AS prompt_sha256 FROM probes"))
def render_user_text(spark, sf_dir):
    text = x.render_user_text(F.concat(F.lit("  "), F.col("next_action"), F.lit("\n")), F.col("event_id").cast("string"), "state_index")
    return t.probes(spark, sf_dir).select("question_id", "state_index", F.sha2(text, 256).alias("prompt_sha256"))


def _verdicts(spark, sf_dir):
    """Raw verdicts of every kind of fault, one an event."""
    gap = '{"category": "attribute", "target": "%d", "slot": "s", "description": "d"}'
    kinds = [
        F.lit('{"sufficient": true, "gap_items": []}'), F.format_string('{"sufficient": false, "gap_items": [' + gap + "]}", "event_id"), F.lit('{"sufficient": true'), F.lit('{"sufficient": 1, "gap_items": []}'),
        F.format_string('{"sufficient": true, "gap_items": [' + gap + "]}", "event_id"), F.lit('{"sufficient": false, "gap_items": []}'), F.lit('{"sufficient": false, "gap_items": [{"category": "attribute"}]}'),
        F.format_string('{"sufficient": false, "gap_items": [' + gap.replace('"d"', '" "') + "]}", "event_id"), F.format_string('{"sufficient": false, "gap_items": [' + gap.replace("attribute", "color") + "]}", "event_id"), F.col("props"),
    ]
    return t.read(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*kinds), (F.col("event_id") % len(kinds) + 1).cast("int")).alias("raw"))


VERDICTS = r"""raws AS (SELECT event_id, [
  '{"sufficient": true, "gap_items": []}', '{"sufficient": false, "gap_items": [{"category": "attribute", "target": "' || event_id || '", "slot": "s", "description": "d"}]}', '{"sufficient": true', '{"sufficient": 1, "gap_items": []}',
  '{"sufficient": true, "gap_items": [{"category": "attribute", "target": "' || event_id || '", "slot": "s", "description": "d"}]}', '{"sufficient": false, "gap_items": []}', '{"sufficient": false, "gap_items": [{"category": "attribute"}]}',
  '{"sufficient": false, "gap_items": [{"category": "attribute", "target": "' || event_id || '", "slot": "s", "description": " "}]}', '{"sufficient": false, "gap_items": [{"category": "color", "target": "' || event_id || '", "slot": "s", "description": "d"}]}', props][event_id % 10 + 1] AS raw FROM events),
js AS (SELECT event_id, json_valid(raw) AS ok, CASE WHEN json_valid(raw) THEN raw ELSE '{}' END AS j FROM raws),
faults AS (SELECT event_id, CASE WHEN NOT ok THEN 'json_decode:JSONDecodeError:Expecting '','' delimiter: line 1 column 20 (char 19)' WHEN list_sort(json_keys(j)) <> ['gap_items', 'sufficient'] THEN 'top_level_schema'
  WHEN json_type(j, '$.sufficient') <> 'BOOLEAN' OR json_type(j, '$.gap_items') <> 'ARRAY' THEN 'top_level_types' WHEN j ->> '$.sufficient' = 'true' AND json_array_length(j, '$.gap_items') > 0 THEN 'sufficient_requires_empty_gap_items'
  WHEN j ->> '$.sufficient' = 'false' AND json_array_length(j, '$.gap_items') = 0 THEN 'insufficient_requires_nonempty_gap_items' WHEN json_array_length(j, '$.gap_items') = 0 THEN NULL
  WHEN list_sort(json_keys(j, '$.gap_items[0]')) <> ['category', 'description', 'slot', 'target'] THEN 'gap_item_schema' WHEN list_contains([trim(j ->> ('$.gap_items[0].' || k)) FOR k IN ['category', 'target', 'slot', 'description']], '') THEN 'gap_item_types_or_empty'
  WHEN j ->> '$.gap_items[0].category' NOT IN ('bridge entity', 'attribute', 'relation', 'evidence span', 'other') THEN 'gap_item_category' END AS fault FROM js)"""


@query("strict_verdict", f"WITH {VERDICTS} SELECT event_id, fault IS NULL AS parsed, fault AS parse_error FROM faults")
def strict_verdict(spark, sf_dir):
    return _verdicts(spark, sf_dir).withColumn("v", x.strict_verdict("raw")).select("event_id", F.col("v.parsed").isNotNull().alias("parsed"), F.col("v.parse_error").alias("parse_error"))


@query("parse_rate", f"WITH {VERDICTS} SELECT count(*) FILTER (fault IS NULL) AS parsed, count(*) AS total, round(count(*) FILTER (fault IS NULL) / count(*)::DOUBLE, 9) AS rate FROM faults")
def parse_rate(spark, sf_dir):
    v = _verdicts(spark, sf_dir).select(x.strict_verdict("raw").alias("v"))
    return rounded(v.agg(F.count("v.parsed").alias("parsed"), F.count("*").alias("total")).withColumn("rate", F.col("parsed") / F.col("total")))


@query("parse_failure_flag", "SELECT event_id, event_id % 2 = 0 AND event_id % 3 = 0 AS failed FROM events")
def parse_failure_flag(spark, sf_dir):
    from waymark.functions.scores import parse_failed

    parsed = F.when(F.col("event_id") % 3 != 0, F.col("props"))
    return t.read(spark, sf_dir, "events").select("event_id", parse_failed(F.col("event_id") % 2 == 0, parsed).alias("failed"))


SENTENCES = r"""n AS (SELECT item_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g')) AS text FROM benchmark),
i AS (SELECT item_id, CAST(generate_subscripts(s, 1) AS BIGINT) - 1 AS k, unnest(s) AS sentence FROM (SELECT item_id, [trim(y) FOR y IN string_split(text, '.') IF trim(y) <> ''] AS s FROM n)),
d AS MATERIALIZED (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\x1c-\x1f\x85\xa0]+', ' ', 'g')) AS text FROM documents),
u AS (SELECT DISTINCT sentence FROM i), hits AS (SELECT item_id, k, doc_id FROM i JOIN (SELECT sentence, doc_id FROM u JOIN d ON contains(d.text, u.sentence)) USING (sentence)),
titles AS (SELECT item_id, array_to_string(string_split(text, ' ')[1:2], ' ') AS title FROM n WHERE text <> '')"""


def _items(spark, sf_dir):
    """Items and documents, normalised."""
    return t.read(spark, sf_dir, "benchmark").select("item_id", x.normalize_question("text").alias("text")), t.read(spark, sf_dir, "documents").select("doc_id", x.normalize_question("text").alias("text"))


def _sentences(items):
    """Every sentence of every item, whatever its length."""
    return items.select("item_id", F.posexplode(F.filter(F.transform(F.split("text", r"\."), lambda y: F.btrim(y)), lambda y: y != "")).alias("k", "sentence")).withColumn("k", F.col("k").cast("long"))


def _titles(items):
    """An item's first two words stand for its title."""
    return items.where("text <> ''").select("item_id", F.array_join(F.slice(F.split("text", " "), 1, 2), " ").alias("title"))


@query("sentence_containment", f"WITH {SENTENCES} SELECT item_id, k, doc_id FROM hits")
def sentence_containment(spark, sf_dir):
    items, docs = _items(spark, sf_dir)
    return containment.contained(_sentences(items), docs, ["item_id", "k"], "sentence", "doc_id", "text")


@query("title_containment", f"WITH {SENTENCES} SELECT item_id, doc_id FROM titles JOIN d ON contains(d.text, title)")
def title_containment(spark, sf_dir):
    items, docs = _items(spark, sf_dir)
    return containment.contained(_titles(items), docs, ["item_id"], "title", "doc_id", "text")


COVERED = "c AS (SELECT item_id, count(*) AS n FROM i GROUP BY 1), f AS (SELECT item_id, count(DISTINCT k) AS found FROM hits GROUP BY 1), tt AS (SELECT DISTINCT item_id FROM titles JOIN d ON contains(d.text, title)), covered AS (SELECT c.item_id, coalesce(found, 0) = n AS sentence_complete, c.item_id IN (SELECT item_id FROM tt) AS title_complete FROM c LEFT JOIN f USING (item_id))"


@query("coverage_counts", f"WITH {SENTENCES}, {COVERED} SELECT title_complete, sentence_complete, count(*) AS n FROM covered GROUP BY 1, 2")
def coverage_counts(spark, sf_dir):
    items, docs = _items(spark, sf_dir)
    s = _sentences(items)
    found = containment.present(s, docs, ["item_id", "k"], "sentence", "text").withColumn("hit", F.lit(1))
    by_item = s.join(found, ["item_id", "k"], "left").groupBy("item_id").agg((F.count("*") == F.count("hit")).alias("sentence_complete"))
    titled = containment.present(_titles(items), docs, ["item_id"], "title", "text").withColumn("title_complete", F.lit(True))
    return by_item.join(titled, "item_id", "left").groupBy(F.coalesce("title_complete", F.lit(False)).alias("title_complete"), "sentence_complete").agg(F.count("*").alias("n"))


@query("conflict_filter", f"WITH {SENTENCES}, {COVERED} SELECT item_id, sentence_complete AND item_id % 3 <> 0 AS conflict FROM covered")
def conflict_filter(spark, sf_dir):
    items, docs = _items(spark, sf_dir)
    s = _sentences(items)
    return containment.conflicts(s, containment.present(s, docs, ["item_id", "k"], "sentence", "text"), ["item_id"], "k", (F.col("item_id") % 3 == 0)).select("item_id", "conflict")


@query("supporting_sentences", "SELECT conv_id, turn AS k, sha256(text) AS sentence_sha256 FROM conversations")
def supporting_sentences(spark, sf_dir):
    c = t.read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("r"))
    context = c.select("conv_id", F.array(F.struct(F.lit("t").alias("title"), F.transform("r", lambda y: y["text"]).alias("sentences"))).alias("context"), F.transform("r", lambda y: F.struct(F.lit("t").alias("title"), y["turn"].alias("index"))).alias("facts"))
    return containment.supporting(context, "conv_id").select("conv_id", F.col("index").alias("k"), F.sha2("sentence", 256).alias("sentence_sha256"))
