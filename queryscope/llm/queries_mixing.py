"""op10: documents sampled so that sources, languages and topics get their target shares of tokens."""
from pyspark.sql import functions as F

from queryscope.llm import mixing
from queryscope.llm.registry import query
from queryscope.workloads.registry import table

POWERS = {"source": 0.8, "lang": 0.9, "topic": 0.95}


def topic():
    """The tables name no topic; marks in the text stand in for a classifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return F.when(text.contains("icensed under"), "licence").when(text.contains("@"), "contact").when(text.contains(" | "), "listing").otherwise("prose")


@query("op10_mixture", r"""
WITH RECURSIVE d AS (SELECT doc_id, source, lang, coalesce(source, '') AS s0, coalesce(lang, '') AS s1,
  CASE WHEN contains(coalesce(text, ''), 'icensed under') THEN 'licence' WHEN contains(coalesce(text, ''), '@') THEN 'contact' WHEN contains(coalesce(text, ''), ' | ') THEN 'listing' ELSE 'prose' END AS s2,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents),
c AS (SELECT s0, s1, s2, CAST(sum(n) AS DOUBLE) AS tokens FROM d GROUP BY ALL),
t0 AS (SELECT s0, pow(sum(tokens), 0.8) / sum(pow(sum(tokens), 0.8)) OVER () AS t FROM c GROUP BY 1),
t1 AS (SELECT s1, pow(sum(tokens), 0.9) / sum(pow(sum(tokens), 0.9)) OVER () AS t FROM c GROUP BY 1),
t2 AS (SELECT s2, pow(sum(tokens), 0.95) / sum(pow(sum(tokens), 0.95)) OVER () AS t FROM c GROUP BY 1),
r AS (
  SELECT 0 AS step, s0, s1, s2, tokens, tokens / sum(tokens) OVER () / 0.75 AS full_w, tokens / sum(tokens) OVER () AS u, 0.0::DOUBLE AS moved FROM c
  UNION ALL
  SELECT step + 1, s0, s1, s2, tokens, full_w, u * by_, greatest(CASE WHEN step % 3 = 0 THEN 0 ELSE moved END, max(abs(by_ - 1)) OVER ())
  FROM (SELECT r.*, coalesce(CASE WHEN step % 3 = 0 THEN t0.t / nullif(sum(least(u, full_w)) OVER (PARTITION BY s0), 0) WHEN step % 3 = 1 THEN t1.t / nullif(sum(least(u, full_w)) OVER (PARTITION BY s1), 0)
      ELSE t2.t / nullif(sum(least(u, full_w)) OVER (PARTITION BY s2), 0) END, 1) AS by_
    FROM r JOIN t0 USING (s0) JOIN t1 USING (s1) JOIN t2 USING (s2) WHERE step < 72 AND NOT (step > 0 AND step % 12 = 0 AND moved < 1e-6))),
f AS (SELECT s0, s1, s2, least(u, full_w) AS w, coalesce(least(u, full_w) / nullif(full_w, 0), 1) AS p FROM r WHERE step = (SELECT max(step) FROM r))
SELECT doc_id, source, lang, s2 AS topic, n AS n_tokens, round(w, 6) AS weight, round(p, 6) AS probability,
  CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 < p AS sampled
FROM d JOIN f USING (s0, s1, s2)""")
def op10_mixture(spark, sf_dir):
    docs, (t, n, w, p, s) = mixing.mixed(table(spark, sf_dir, "documents"), topic(), POWERS)
    return docs.select("doc_id", "source", "lang", F.col(t).alias("topic"), F.col(n).alias("n_tokens"), F.round(w, 6).alias("weight"), F.round(p, 6).alias("probability"), F.col(s).alias("sampled"))
