"""op2: every conversation against a degraded version of itself, as preference records."""
from pyspark.sql import functions as F

from queryscope.llm import preferences
from queryscope.llm.registry import query
from queryscope.workloads.registry import table

_TEXT = "'<|im_start|>' || replace(t.role, '<|', '< |') || chr(10) || replace(t.text, '<|', '< |') || '<|im_end|>' || chr(10)"


def _ends(x):
    return f"list_transform(range(1, len({x}) + 1), lambda i: CAST(list_sum(list_transform({x}[1:i], lambda s: length(s))) AS BIGINT))"


def _mask(turns, x):
    begin = f"{x}e[i] - length({x}t[i]) + length(replace({turns}[i].role, '<|', '< |')) + 13"
    return f"array_to_string(list_transform(list_filter(range(1, len({turns}) + 1), lambda i: {turns}[i].role = 'assistant'), lambda i: CAST({begin} AS VARCHAR) || ':' || CAST({x}e[i] - 1 AS VARCHAR)), ',')"


@query("op2_preference_records", f"""
WITH a AS (SELECT conv_id, list(struct_pack(role := coalesce(role, ''), text := coalesce(text, '')) ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS c FROM conversations GROUP BY 1),
b AS (SELECT *, list_filter(range(1, len(c) + 1), lambda i: c[i].role = 'assistant') AS pos FROM a),
d AS (SELECT conv_id, c, CASE WHEN len(pos) = 0 THEN c ELSE list_concat(c[1:pos[len(pos)] - 1], [struct_pack(role := 'assistant', text := CASE WHEN len(pos) > 1 THEN c[pos[1]].text ELSE c[pos[1]].text[1:length(c[pos[1]].text) // 2] END)]) END AS r FROM b),
n AS (SELECT *, coalesce(list_filter(range(1, least(len(c), len(r)) + 1), lambda i: c[i] <> r[i])[1] - 1, least(len(c), len(r))) AS n FROM d),
s AS (SELECT conv_id, n, c[1:n] AS p, c[n + 1:] AS cc, r[n + 1:] AS rr FROM n),
t AS (SELECT *, list_transform(p, lambda t: {_TEXT}) AS pt, list_transform(cc, lambda t: {_TEXT}) AS ct, list_transform(rr, lambda t: {_TEXT}) AS rt FROM s),
e AS (SELECT *, {_ends('ct')} AS ce, {_ends('rt')} AS re FROM t)
SELECT conv_id, array_to_string(pt, '') AS prompt, array_to_string(ct, '') AS chosen, array_to_string(rt, '') AS rejected, {_mask('cc', 'c')} AS chosen_mask, {_mask('rr', 'r')} AS rejected_mask,
  n AS prompt_turns, len(cc) > 0 AND len(rr) > 0 AS usable FROM e""")
def op2_preference_records(spark, sf_dir):
    """The table holds no rejected answers, so a degraded version of each conversation stands for them."""
    chosen = preferences.assemble(table(spark, sf_dir, "conversations"), "conv_id", "chosen")
    return preferences.format_pairs(chosen.withColumn("rejected", preferences.degraded(F.col("chosen"))), "conv_id")
