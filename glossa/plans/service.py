"""Registered queries of the lookup service, of graph views, of alignment and of reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import grounding, lookup, ontology, report, stats
from glossa.plans.adapters import Tables
from glossa.plans.registry import NEAREST, query
from glossa.sources import readers

# ---- the lookup service -------------------------------------------------------------------------------------------

ENGLISH = """, en AS (SELECT lower(name) AS key, arg_min(id, (-level, id)) AS id FROM concept GROUP BY 1),
asked AS (SELECT DISTINCT word AS term, 'fr' AS lang FROM span UNION SELECT id, 'fr' FROM concept WHERE level < 5 UNION SELECT lower(name), 'en' FROM concept WHERE level IN (2, 4) UNION SELECT ' ', 'fr'),
own AS (SELECT term, lang, trim(replace(term, 'ß', 'ss')) AS key FROM asked)
"""


def asked(t: Tables) -> DataFrame:
    """French: all document words, codes and a blank; English: names of two tiers."""
    c = t.concepts()
    french = t.spans().select(F.col("word").alias("term")).unionByName(c.where("level < 5").select(F.col("id").alias("term"))).unionByName(t.spark.range(1).select(F.lit(" ").alias("term")))
    return french.select("term", F.lit("fr").alias("lang")).unionByName(c.where("level in (2, 4)").select(F.lower("name").alias("term"), F.lit("en").alias("lang")))


@query(
    NEAREST + ENGLISH + """SELECT lang, source, count(*) AS terms, min(id) AS first FROM (
SELECT o.term, o.lang, CASE WHEN o.key = '' THEN 'blank' WHEN c.id IS NOT NULL THEN 'code' WHEN lang = 'fr' AND x.n_concepts > 1 THEN 'ambiguous' WHEN lang = 'fr' AND x.id IS NOT NULL OR lang = 'en' AND en.id IS NOT NULL THEN 'exact' WHEN lang = 'fr' AND hit.key IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS source,
  CASE WHEN c.id IS NOT NULL THEN c.id WHEN lang = 'fr' THEN x.id ELSE en.id END AS id
FROM own o LEFT JOIN concept c ON c.id = o.key LEFT JOIN label_index x ON x.key = o.key LEFT JOIN en ON en.key = o.key LEFT JOIN hit ON hit.key = o.key) GROUP BY ALL""",
    recursive=True,
)
def lookup_service(t: Tables) -> DataFrame:
    """Where each term is found; the smallest id of each kind but the fuzzy one, whose ties SQL does not follow."""
    c = t.concepts()
    found = lookup.lookup(asked(t), c, grounding.label_index(c), grounding.fuzzy_index(c))
    own = F.when(F.col("source") != "fuzzy", F.col("id"))
    return found.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("terms"), F.min(own).alias("first"))


@query("""SELECT term, id, source, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY arrival) AS rank FROM (
  SELECT q.w AS term, c.id, CASE WHEN count(*) OVER (PARTITION BY q.w) > 1 THEN 'ambiguous' ELSE 'exact' END AS source, 100.0::DOUBLE AS score, '0' || c.level || c.id AS arrival FROM vocab q JOIN concept c ON replace(c.fr_label, 'ß', 'ss') = replace(q.w, 'ß', 'ss')
  UNION ALL SELECT q.w, c.id, 'substring', 100.0, '3' || c.id FROM vocab q JOIN concept c ON contains(replace(c.fr_label, 'ß', 'ss'), replace(q.w, 'ß', 'ss')) WHERE replace(q.w, 'ß', 'ss') NOT IN (SELECT key FROM label_index))) WHERE rank <= 8""")
def candidates(t: Tables) -> DataFrame:
    """Candidates of the benchmark's words: under their label, else within one."""
    return lookup.collect_candidates(t.vocab().select(F.col("w").alias("term")), t.concepts())


@query("""SELECT DISTINCT term, coalesce(c.id, n.id) AS id FROM (SELECT id AS term FROM concept UNION SELECT upper(name) FROM concept UNION SELECT w FROM vocab) q
LEFT JOIN concept c ON c.id = lower(trim(q.term)) LEFT JOIN (SELECT lower(name) AS key, arg_min(id, (-level, id)) AS id FROM concept GROUP BY 1) n ON n.key = lower(trim(q.term)) WHERE coalesce(c.id, n.id) IS NOT NULL""")
def concept_by_id(t: Tables) -> DataFrame:
    c = t.concepts()
    terms = c.select(F.col("id").alias("term")).unionByName(c.select(F.upper("name").alias("term"))).unionByName(t.vocab().select(F.col("w").alias("term")))
    return ontology.by_code_or_name(terms, c).select("term", "concept.id")


# ---- views of the graph -------------------------------------------------------------------------------------------


@query(""", rel AS (SELECT child AS id, 'p' AS kind, parent AS other FROM (SELECT DISTINCT * FROM edge_thin) WHERE parent <> child UNION ALL SELECT parent, 'c', child FROM (SELECT DISTINCT * FROM edge_thin) WHERE parent <> child),
o AS (SELECT r.id, r.kind, c.name, row_number() OVER (PARTITION BY r.id, r.kind ORDER BY c.name, r.other) AS place FROM rel r JOIN concept c ON c.id = r.other)
SELECT id, count(*) FILTER (kind = 'p') AS n_parents, count(*) FILTER (kind = 'c') AS n_children, coalesce(string_agg(name, '|' ORDER BY place) FILTER (kind = 'p' AND place <= 16), '') AS parents,
  coalesce(string_agg(name, '|' ORDER BY place) FILTER (kind = 'c' AND place <= 16), '') AS children FROM o GROUP BY id""")
def neighborhood(t: Tables) -> DataFrame:
    found = ontology.neighbourhood(t.edges(thin=True), t.concepts())
    return found.select("id", "n_parents", "n_children", F.array_join("parents", "|").alias("parents"), F.array_join("children", "|").alias("children"))


@query("SELECT key, id, name, level, row_number() OVER (PARTITION BY key ORDER BY level, id) AS place FROM (SELECT DISTINCT replace(fr_label, 'ß', 'ss') AS key, id, name, level FROM concept WHERE fr_label IS NOT NULL) JOIN (SELECT key FROM label_index WHERE n_concepts > 1) USING (key)")
def alternatives(t: Tables) -> DataFrame:
    return ontology.alternatives(t.concepts())


@query("SELECT count(*) AS concepts, count(CASE WHEN trim(fr_label) <> '' THEN 1 END) AS labels, count(CASE WHEN trim(fr_label) <> '' THEN 1 END) > 0 AS populated FROM concept")
def graph_populated(t: Tables) -> DataFrame:
    return ontology.populated(t.concepts())


@query(""", lv AS (SELECT (2000000 + n_nationkey)::VARCHAR AS code, 'pays ' || lower(n_name) AS label, 0 AS file, n_nationkey AS line FROM nation
  UNION ALL SELECT (4000000 + p_partkey)::VARCHAR, p_type, 1, p_partkey FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT (4000000 + p_partkey)::VARCHAR, p_brand, 1, p_partkey + 1000000 FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT (4000000 + p_partkey)::VARCHAR, CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_name END, 2, p_partkey FROM part WHERE p_partkey % 5 = 0)
SELECT id, name, coalesce(n.label, fr_label) AS fr_label FROM concept LEFT JOIN (SELECT code, arg_max(label, (file, line)) AS label FROM lv WHERE trim(label) <> '' GROUP BY code) n ON n.code = id""")
def level_files(t: Tables) -> DataFrame:
    """Labels from three files of level tables; later files and lines win, blank labels don't count."""
    c = F.col

    def codes(df, key, label, line):
        return df.select(key.cast("string").alias("code"), label.alias("label"), line.cast("long").alias("line"))

    part = 4000000 + c("p_partkey")
    second = codes(t.part.where("p_partkey % 2 = 0"), part, c("p_type"), c("p_partkey")).unionByName(codes(t.part.where("p_partkey % 4 = 0"), part, c("p_brand"), c("p_partkey") + 1000000))
    third = codes(t.part.where("p_partkey % 5 = 0"), part, F.when(c("p_partkey") % 3 == 0, " ").otherwise(c("p_name")), c("p_partkey"))
    first = codes(t.nation, 2000000 + c("n_nationkey"), F.concat(F.lit("pays "), F.lower("n_name")), c("n_nationkey"))
    return ontology.update_labels(t.concepts(), first, second, third).select("id", "name", "fr_label")


@query("SELECT p_partkey, (9000000 + p_partkey)::VARCHAR AS pt_code, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_name END AS pt_name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 7 <> 0", views=False)
def primary_branch(t: Tables) -> DataFrame:
    """Lines of the old layout, filled from two code files; every third line is not primary, every seventh term has no parent."""
    c = F.col
    k, code = c("p_partkey").cast("string"), (9000000 + c("p_partkey")).cast("string")
    flag = F.when(c("p_partkey") % 3 == 0, "n").otherwise("y")
    line = F.concat_ws("$", k, k, k, k, c("p_name"), F.lit("h"), F.lit("g"), F.lit("s"), F.lit("ab"), F.lit(""), k, flag, F.lit(""))
    parsed = t.part.select("p_partkey", ontology.parse_hierarchy(T.split_fields(line)).alias("h")).select("p_partkey", "h.*")
    parents = t.part.where("p_partkey % 7 <> 0").select(k.alias("llt_code"), code.alias("parent_pt"))
    names = t.part.where("p_partkey % 2 = 0").select(code.alias("pt_code"), c("p_type").alias("pt_label"))
    return ontology.primary_rows(ontology.enrich(parsed, parents, names)).select("p_partkey", "pt_code", "pt_name")


@query("SELECT CASE WHEN regexp_full_match(id, '[0-9]+') THEN 'coded' ELSE 'legacy' END AS kind, count(*) AS n FROM (SELECT id FROM concept UNION ALL SELECT name FROM concept WHERE level < 3) GROUP BY 1")
def id_kinds(t: Tables) -> DataFrame:
    """Coded and legacy ids; names stand in as legacy ones."""
    c = t.concepts()
    ids = c.select("id").unionByName(c.where("level < 3").select(F.col("name").alias("id")))
    return ids.groupBy(F.when(F.col("id").rlike("^[0-9]+$"), "coded").otherwise("legacy").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


# ---- alignment and reports ----------------------------------------------------------------------------------------


@query("SELECT d.doc_id::VARCHAR AS id, md5(d.text) AS hyp, l.toxic AS ref, d.lang AS src FROM documents d JOIN labels l USING (doc_id) WHERE d.lang <> 'en'", views=False)
def aligned_pairs(t: Tables) -> DataFrame:
    """Results, references and sources by id; ids are compared as text."""
    d = t.documents
    results = d.select(F.col("doc_id").alias("id"), F.md5("text").alias("hyp"))
    references = t.labels.select(F.col("doc_id").cast("string").alias("id"), F.col("toxic").alias("ref"))
    return readers.aligned(results, references, d.where("lang <> 'en'").select(F.col("doc_id").alias("id"), F.col("lang").alias("src")))


@query("SELECT d.doc_id AS id, d.lang, s.pos FROM documents d JOIN (SELECT doc_id, row_number() OVER (ORDER BY md5('7-' || doc_id), doc_id) AS pos FROM labels ORDER BY pos LIMIT 40) s USING (doc_id)", views=False)
def sample_in_order(t: Tables) -> DataFrame:
    """Forty drawn labels, a sample whose file order the rows keep."""
    ids = t.labels.orderBy(F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string"))), "doc_id").limit(40)
    ids = ids.withColumn("mark", F.md5(F.concat(F.lit("7-"), F.col("doc_id").cast("string"))))
    ids = ids.select(F.posexplode(F.array_sort(F.collect_list(F.struct("mark", "doc_id")))).alias("pos", "x")).select(F.col("x.doc_id").alias("id"), (F.col("pos") + 1).cast("long").alias("pos"))
    return readers.in_order(ids, t.documents.select(F.col("doc_id").alias("id"), "lang")).select("id", "lang", "pos")


@query("SELECT user_id, arg_min(value, event_id) FILTER (value IS NOT NULL AND event_type <> 'view') AS value FROM events GROUP BY user_id", views=False)
def first_known_value(t: Tables) -> DataFrame:
    """The first value in file order; those of one type count as missing."""
    rows = t.events.select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("value"))
    return stats.first_known(rows, "user_id", "value", "event_id")


@query("SELECT s_suppkey, CASE WHEN n.v IS NULL THEN s_acctbal ELSE n.v END AS ccr, n.v IS NOT NULL AS renewed FROM supplier LEFT JOIN (SELECT l_suppkey, round(avg(l_discount), 6) AS v FROM lineitem WHERE l_suppkey % 3 = 0 GROUP BY 1) n ON l_suppkey = s_suppkey", views=False)
def override_values(t: Tables) -> DataFrame:
    """Computed figures over stored ones, where there are any."""
    old = t.supplier.select("s_suppkey", F.col("s_acctbal").alias("ccr"))
    fresh = t.lineitem.where("l_suppkey % 3 = 0").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.round(F.avg("l_discount"), 6).alias("ccr"))
    return stats.override(old, fresh, "s_suppkey", "ccr")


@query("SELECT word AS term, category, idx FROM (SELECT word, CASE WHEN n_concepts > 1 THEN 'AMBIGUOUS' WHEN id IS NULL THEN 'NOT_IN_GRAPH' ELSE 'EXACT_HIT' END AS category, CASE WHEN n_concepts > 1 THEN 0 WHEN id IS NULL THEN 1 ELSE 2 END AS idx FROM (SELECT DISTINCT word, n_concepts, id FROM grounded))")
def report_order(t: Tables) -> DataFrame:
    """Exact categories of all words in the order of the report."""
    found = t.spans().select("word").distinct()
    found = found.join(grounding.label_index(t.concepts()), T.norm_key(F.col("word"), wide=False) == F.col("key"), "left")
    category = F.when(F.col("n_concepts") > 1, "AMBIGUOUS").when(F.col("n_concepts").isNull(), "NOT_IN_GRAPH").otherwise("EXACT_HIT")
    return report.in_category_order(found.select(F.col("word").alias("term"), category.alias("category")), grounding.CATEGORIES)


@query("SELECT event_type AS label, CASE event_type WHEN 'view' THEN 'S1 NLLB' WHEN 'click' THEN 'S4 rerank' ELSE event_type END AS display, 'run/' || event_type AS condition, count(*) AS n FROM events GROUP BY event_type", views=False)
def display_labels(t: Tables) -> DataFrame:
    label = F.when(F.col("event_type") == "view", "s1").when(F.col("event_type") == "click", "s4").otherwise(F.col("event_type"))
    folder = F.concat(F.lit(" /results/run/"), F.col("event_type"), F.lit("/ "))
    rows = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("event_type").alias("label"), report.display_label(label).alias("display"), report.condition_name(folder).alias("condition"), "n")


@query(
    """, rl AS (SELECT DISTINCT e.child AS id, 'p' AS kind, c.id AS other, c.name, c.level FROM edge_thin e JOIN concept c ON c.id = e.parent WHERE e.parent <> e.child
  UNION ALL SELECT DISTINCT e.parent, 'c', c.id, c.name, c.level FROM edge_thin e JOIN concept c ON c.id = e.child WHERE e.parent <> e.child),
pl AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY level, name, other) AS place FROM rl),
rs AS (SELECT id, count(*) FILTER (kind = 'p') AS n_parents, count(*) FILTER (kind = 'c') AS n_children, string_agg(name, '|' ORDER BY place) FILTER (kind = 'p' AND place <= 200) AS parent_names,
  string_agg(other, '|' ORDER BY place) FILTER (kind = 'c' AND place <= 200) AS children FROM pl GROUP BY id),
up(id, node, hops) AS (SELECT id, id, 0 FROM concept UNION SELECT up.id, e.parent, up.hops + 1 FROM up JOIN edge_thin e ON e.child = up.node WHERE up.hops < 6),
ab AS (SELECT u.id, string_agg(c.name, ' › ' ORDER BY c.level, c.name, c.id) AS ancestor_summary FROM (SELECT DISTINCT id, node FROM up) u JOIN concept c ON c.id = u.node GROUP BY u.id)
SELECT c.id, c.name, c.level, c.tier, nullif(trim(c.fr_label), '') AS fr_label, coalesce(n_parents, 0) AS n_parents, coalesce(n_children, 0) AS n_children, coalesce(parent_names, '') AS parent_names, coalesce(children, '') AS children, ancestor_summary
FROM concept c LEFT JOIN rs USING (id) JOIN ab USING (id)""",
    recursive=True,
)
def concept_views(t: Tables) -> DataFrame:
    """The view of every concept."""
    c = t.concepts()
    rows = lookup.concept_views(c, c, t.edges(thin=True))
    shown = [F.col(f"view.{k}").alias(k) for k in ("name", "level", "tier", "fr_label")]
    children = F.array_join(F.transform("children", lambda x: x["id"]), "|").alias("children")
    return rows.select("id", *shown, "n_parents", "n_children", F.array_join("parent_names", "|").alias("parent_names"), children, "ancestor_summary")
