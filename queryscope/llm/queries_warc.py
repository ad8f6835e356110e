"""op7: pages written as deduplicated archives and read back."""
from queryscope.llm import warc
from queryscope.llm.common import stored
from queryscope.llm.registry import query
from queryscope.workloads.registry import table


@query("op7_warc_revisits", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT payload_digest AS d, payload_bytes AS b, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1, 2)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN o ON d = payload_digest AND b = payload_bytes""")
def op7_warc_revisits(spark, sf_dir):
    files, folder = warc.archive(table(spark, sf_dir, "pages"))
    return warc.resolved_records(stored(warc.read_records(files, folder), "warc-records"))
