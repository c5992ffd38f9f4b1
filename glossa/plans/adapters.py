"""Views of the test tables in the shapes that the operators take, and the same views as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = r"[a-zà-ÿ]+"


class Tables:
    """The tables of one directory and the views on them; each view is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def vocab(self) -> DataFrame:
        """(w, r): words of the benchmark by frequency; the vocabulary is bounded by that table."""
        words = self.benchmark.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("w")).where(F.length("w") >= 4)
        counts = words.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
        return counts.select("w", F.row_number().over(Window.orderBy(F.desc("n"), "w")).alias("r"))

    def labelled_parts(self) -> DataFrame:
        """(p_partkey, fr_label, name): labels repeat, so ambiguous keys exist; null where words run out."""
        n = self.part.agg(F.floor(F.count(F.lit(1)) * 0.8).alias("n"))
        own, other = self.vocab(), self.vocab().select(F.col("w").alias("w2"), F.col("r").alias("r2"))
        parts = self.part.select("p_partkey").crossJoin(F.broadcast(n))  # one row: the number of parts
        joined = parts.join(own, F.col("r") == 1 + F.col("p_partkey") % F.col("n"), "left").join(other, F.col("r2") == 1 + (F.col("p_partkey") + 7) % F.col("n"), "left")
        return joined.select("p_partkey", F.col("w").alias("fr_label"), F.coalesce("w2", F.concat(F.lit("part "), F.col("p_partkey").cast("string"))).alias("name"))

    def concepts(self) -> DataFrame:
        """(id, name, level, tier, fr_label) in five tiers. Kept, as queries join this table with itself under several keys; what memory lacks goes to disk."""
        return self._concepts().persist()

    def _concepts(self) -> DataFrame:
        def tier(df: DataFrame, key, name, level: int, code: str, label) -> DataFrame:
            return df.select(key.cast("string").alias("id"), name.alias("name"), F.lit(level).alias("level"), F.lit(code).alias("tier"), label.alias("fr_label"))

        c = F.col
        parts = self.labelled_parts()
        flags = self.lineitem.select("l_partkey", "l_returnflag").distinct().join(parts, c("l_partkey") == c("p_partkey"))
        low = F.lower("l_returnflag")
        leaf_key = 50000000 + 10 * c("l_partkey") + F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
        return (
            tier(self.region, 1000000 + c("r_regionkey"), c("r_name"), 1, "SOC", F.lower("r_name"))
            .unionByName(tier(self.nation, 2000000 + c("n_nationkey"), c("n_name"), 2, "HLGT", F.lower("n_name")))
            .unionByName(tier(self.supplier, 3000000 + c("s_suppkey"), c("s_name"), 3, "HLT", F.lower("s_name")))
            .unionByName(tier(parts, 4000000 + c("p_partkey"), c("name"), 4, "PT", c("fr_label")))
            .unionByName(tier(flags, leaf_key, F.concat("name", F.lit(" "), low), 5, "LLT", F.concat("fr_label", F.lit(" "), low)))
        )

    def edges(self, thin: bool = False) -> DataFrame:
        """(parent, child); ``thin`` keeps one supplier per part. Kept, as concepts are."""
        return self._edges(thin).persist()

    def _edges(self, thin: bool) -> DataFrame:
        c = F.col

        def pair(df: DataFrame, a, b) -> DataFrame:
            return df.select(a.cast("string").alias("parent"), b.cast("string").alias("child"))

        supply = self.lineitem.select("l_suppkey", "l_partkey")
        if thin:
            # Digits of the digest as a number (31 of 32), which is aggregated by hashing where the rows are; strings would sort all of them.
            mark = F.md5(F.concat(c("l_suppkey").cast("string"), F.lit("-"), c("l_partkey").cast("string")))
            digits = [F.conv(F.substring(mark, at, size), 16, 10).cast("decimal(20,0)") for at, size in ((1, 15), (16, 16))]
            mark = (digits[0] * F.lit(str(16**16)).cast("decimal(20,0)") + digits[1]).cast("decimal(38,0)")
            supply = supply.groupBy("l_partkey").agg(F.min_by("l_suppkey", mark).alias("l_suppkey"))
        else:
            supply = supply.distinct()
        leaves = self.lineitem.select("l_partkey", "l_returnflag").distinct()
        leaf_key = 50000000 + 10 * c("l_partkey") + F.when(c("l_returnflag") == "A", 0).when(c("l_returnflag") == "N", 1).otherwise(2)
        return (
            pair(self.nation, 1000000 + c("n_regionkey"), 2000000 + c("n_nationkey"))
            .unionByName(pair(self.supplier, 2000000 + c("s_nationkey"), 3000000 + c("s_suppkey")))
            .unionByName(pair(supply, 3000000 + c("l_suppkey"), 4000000 + c("l_partkey")))
            .unionByName(pair(leaves, 4000000 + c("l_partkey"), leaf_key))
        )

    def spans(self) -> DataFrame:
        """(id, source, lang, word): distinct words of four letters or more of each whole document."""
        words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 4))
        return self.documents.select(F.col("doc_id").alias("id"), "source", "lang", F.explode(words).alias("word"))

    def occurrences(self, by_id: bool = False) -> DataFrame:
        """(id, source, word): every such word at each place; ``by_id`` deals the texts as :meth:`doc_pairs` does, so what is grouped by id stays where it is."""
        words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)), lambda w: F.length(w) >= 4)
        texts = self.documents.select(F.col("doc_id").alias("id"), "source", "text")
        if by_id:
            texts = texts.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "id")
        return texts.select("id", "source", F.explode(words).alias("word"))

    def doc_pairs(self) -> DataFrame:
        """(id, lang, source, hyp, ref): a document against the next of its language and source."""
        # Ids alone are sorted; texts join by id, which spreads evenly. What is done with pairs costs far more than their bytes, so their partitions
        # are as many as the session says, and aren't put together by size.
        n = int(self.documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        ahead = Window.partitionBy("lang", "source").orderBy("doc_id")
        after = self.documents.select(F.col("doc_id").alias("id"), F.lead("doc_id").over(ahead).alias("next")).where("next is not null")
        refs = after.join(self.documents.where("text is not null").select(F.col("doc_id").alias("next"), F.col("text").alias("ref")), "next").drop("next")
        hyps = self.documents.select(F.col("doc_id").alias("id"), "lang", "source", F.col("text").alias("hyp"))
        return hyps.repartition(n, "id").join(refs.repartition(n, "id"), "id")

    def turn_pairs(self) -> DataFrame:
        """(id, doc, ref, hyp): a user's turn and the assistant's that follows."""
        c = self.conversations
        user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("ref"))
        other = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("hyp"))
        return user.join(other, ["conv_id", "turn"]).select(F.concat(F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("doc"), "ref", "hyp")

    def raters(self) -> DataFrame:
        """(pos, d, n, llm): two raters and a model; rows align by position."""
        pos = F.row_number().over(Window.orderBy("doc_id"))
        return self.labels.select(pos.alias("pos"), "doc_id", F.col("quality").alias("d"), F.col("toxic").alias("n"), (F.col("doc_id") % 2).cast("int").alias("llm"))


VIEWS = r"""
vocab AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) AS r FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS w FROM benchmark) WHERE length(w) >= 4 GROUP BY w),
parts_n AS (SELECT floor(count(*) * 0.8)::BIGINT AS n FROM part),
labelled AS (SELECT p_partkey, a.w AS fr_label, coalesce(b.w, 'part ' || p_partkey) AS name FROM part CROSS JOIN parts_n
  LEFT JOIN vocab a ON a.r = 1 + p_partkey % n LEFT JOIN vocab b ON b.r = 1 + (p_partkey + 7) % n),
leaves AS (SELECT DISTINCT l_partkey, l_returnflag, 50000000 + 10 * l_partkey + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS leaf FROM lineitem),
concept AS (
  SELECT (1000000 + r_regionkey)::VARCHAR AS id, r_name AS name, 1 AS level, 'SOC' AS tier, lower(r_name) AS fr_label FROM region
  UNION ALL SELECT (2000000 + n_nationkey)::VARCHAR, n_name, 2, 'HLGT', lower(n_name) FROM nation
  UNION ALL SELECT (3000000 + s_suppkey)::VARCHAR, s_name, 3, 'HLT', lower(s_name) FROM supplier
  UNION ALL SELECT (4000000 + p_partkey)::VARCHAR, name, 4, 'PT', fr_label FROM labelled
  UNION ALL SELECT leaf::VARCHAR, name || ' ' || lower(l_returnflag), 5, 'LLT', fr_label || ' ' || lower(l_returnflag) FROM leaves JOIN labelled ON l_partkey = p_partkey),
supply AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem),
thin AS (SELECT arg_min(l_suppkey, md5(l_suppkey || '-' || l_partkey)) AS l_suppkey, l_partkey FROM supply GROUP BY l_partkey),
frame AS (
  SELECT (1000000 + n_regionkey)::VARCHAR AS parent, (2000000 + n_nationkey)::VARCHAR AS child FROM nation
  UNION ALL SELECT (2000000 + s_nationkey)::VARCHAR, (3000000 + s_suppkey)::VARCHAR FROM supplier
  UNION ALL SELECT (4000000 + l_partkey)::VARCHAR, leaf::VARCHAR FROM leaves),
edge AS (SELECT * FROM frame UNION ALL SELECT (3000000 + l_suppkey)::VARCHAR, (4000000 + l_partkey)::VARCHAR FROM supply),
edge_thin AS (SELECT * FROM frame UNION ALL SELECT (3000000 + l_suppkey)::VARCHAR, (4000000 + l_partkey)::VARCHAR FROM thin),
occurrence AS (SELECT id, source, lang, word FROM (SELECT doc_id AS id, source, lang, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) AS word FROM documents) WHERE length(word) >= 4),
span AS (SELECT DISTINCT id, source, lang, word FROM occurrence),
label_index AS (SELECT replace(fr_label, 'ß', 'ss') AS key, count(DISTINCT id) AS n_concepts, arg_min(id, (level, id)) AS id, arg_min(name, (level, id)) AS name, arg_min(level, (level, id)) AS level
  FROM concept WHERE fr_label IS NOT NULL GROUP BY 1),
grounded AS (SELECT s.id AS seg, s.source, s.lang, s.word, x.id, x.name, x.level, x.n_concepts FROM span s LEFT JOIN label_index x ON x.key = replace(s.word, 'ß', 'ss')),
doc_pair AS (SELECT * FROM (SELECT doc_id AS id, lang, source, text AS hyp, lead(text) OVER (PARTITION BY lang, source ORDER BY doc_id) AS ref FROM documents) WHERE ref IS NOT NULL),
turn_pair AS (SELECT u.conv_id || '_' || u.turn AS id, u.conv_id AS doc, u.text AS ref, a.text AS hyp FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND u.role = 'user' AND a.role = 'assistant'),
rater AS (SELECT row_number() OVER (ORDER BY doc_id) AS pos, doc_id, quality AS d, toxic AS n, (doc_id % 2)::INT AS llm FROM labels)
"""


def sql(body: str, recursive: bool = False) -> str:
    """A query over the views; ``body`` may begin with further views and a comma."""
    return f"WITH {'RECURSIVE ' if recursive else ''}{VIEWS.strip()}{body}"
