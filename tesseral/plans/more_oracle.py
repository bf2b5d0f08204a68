"""SQL of the queries in more_queries, written from the operators' semantics."""

from __future__ import annotations

from tesseral.plans.oracle import _BM25, _DATE, _DEG, _DENSE, _DIR, _OK, _QUERIES, _TOK, SQL, _km, _top

_TERMS = r"list_distinct(list_filter(regexp_split_to_array(lower({c}), '\s+'), lambda x: x <> ''))"
_WITH = "(SELECT d.*, q.title AS query, t.text FROM (SELECT * FROM {src}) d JOIN documents q ON q.doc_id = d.query_id JOIN documents t ON t.doc_id = d.doc_id WHERE q.title IS NOT NULL)"
_DOCS = f"(SELECT * FROM {_DENSE} WHERE doc_id IN (SELECT doc_id FROM documents) AND query_id IN (SELECT doc_id FROM documents WHERE title IS NOT NULL))"


def _stages(first: str, score: str, boost: str = "0.0") -> str:
    mixed = f"""WITH a AS (SELECT query_id, doc_id, score AS dense, query, text FROM {_WITH.format(src=first)}),
s AS (SELECT *, round(coalesce(len(list_intersect({_TERMS.format(c='query')}, {_TERMS.format(c='text')}))::DOUBLE / nullif(sqrt(len({_TERMS.format(c='query')}) * len({_TERMS.format(c='text')})), 0), 0), 6) AS sparse FROM a),
n AS (SELECT *, CASE WHEN max(dense) OVER w = min(dense) OVER w THEN 1.0::DOUBLE ELSE (dense - min(dense) OVER w) / (max(dense) OVER w - min(dense) OVER w) END AS nd,
CASE WHEN max(sparse) OVER w = min(sparse) OVER w THEN 1.0::DOUBLE ELSE (sparse - min(sparse) OVER w) / (max(sparse) OVER w - min(sparse) OVER w) END AS ns FROM s WINDOW w AS (PARTITION BY query_id)),
h AS (SELECT query_id, doc_id, query, text, round(0.65::DOUBLE * nd + (1 - 0.65::DOUBLE) * ns, 6) AS hybrid FROM n),
m AS (SELECT * EXCLUDE (hybrid), round(hybrid + {boost}, 6) AS hybrid FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, doc_id) AS r FROM h) WHERE r <= 30),
c AS (SELECT query_id, doc_id, hybrid, {score} AS score FROM m)
SELECT query_id, doc_id, hybrid, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM c) WHERE rank <= 10"""
    return mixed


_COVER = f"round(CASE WHEN text IS NULL THEN NULL WHEN len(list_distinct({_TOK.format(c='query')})) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct({_TOK.format(c='query')}), {_TOK.format(c='text')}))::DOUBLE / len(list_distinct({_TOK.format(c='query')})) END, 6)"
_ARC = "(SELECT DISTINCT ON (mention_id) mention_id, doc_id, document_id AS arc, dimension_name, text, normalized, category, latitude, longitude FROM mentions WHERE document_id IS NOT NULL)"
_FIRST = f"(SELECT arc, doc_id, min(d) AS d FROM (SELECT *, {_DATE.format(c='normalized')} AS d FROM {_ARC}) WHERE dimension_name = 'temporal' AND doc_id IS NOT NULL AND d IS NOT NULL GROUP BY ALL)"
_YEAR = r"regexp_extract_all(title, '\b((?:19|20)\d{2})\b')"
_QUARTER = r"regexp_extract_all(title, '\b(Q[1-4])\b')"
_FORM = r"(\d{1,2})(?::(\d{2}))?\s*(am|pm)?\s*(?:to|-|–|until)\s*(\d{1,2})(?::(\d{2}))?\s*(am|pm)?(?:[^\d:]|$)"
_CLOCK = "format('{{:02d}}:{{:02d}}', CASE WHEN {p} = 'pm' AND {h} <> 12 THEN {h} + 12 WHEN {p} = 'am' AND {h} = 12 THEN 0 ELSE {h} END, {m})"
_NUM = "coalesce(try_cast(nullif(g.{x}, '') AS INT), 0)"
_EDGE = "(SELECT lower(trim(dimension_name, ' ')) AS dimension, lower(trim(text, ' ')) AS text, coalesce(source, 'none') AS cluster FROM mentions WHERE trim(text, ' ') <> '')"
_ENT = f"(SELECT replace(dimension, ' ', '_') AS dimension, text, count(DISTINCT cluster) AS clusters, count(*) AS mentions FROM {_EDGE} GROUP BY ALL)"

# all terms of the titles asked, split as the operator does
_BM25_ALL = _BM25.replace(f"unnest(string_split(query, ' ')) AS t FROM {_QUERIES}", r"unnest(list_filter(regexp_split_to_array(lower(title), '\s+'), lambda x: x <> '')) AS t FROM (SELECT doc_id AS query_id, title FROM documents WHERE doc_id % 20 = 0 AND title IS NOT NULL)")
_CHORD = "2 * sin(50.0::DOUBLE / 6371.0 / 2)"
# positions of located mentions, the pairs within reach, and the least position of each component
_CLUSTERS = f"""WITH RECURSIVE m AS (SELECT DISTINCT mention_id, cos(radians(latitude)) * cos(radians(longitude)) AS x, cos(radians(latitude)) * sin(radians(longitude)) AS y, sin(radians(latitude)) AS z FROM mentions WHERE dimension_name = 'spatial' AND {_OK}),
p AS (SELECT x, y, z, count(*) AS n, row_number() OVER (ORDER BY x, y, z) AS id FROM m GROUP BY x, y, z),
e AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2) <= pow({_CHORD}, 2)),
c AS (SELECT id, id AS l FROM p UNION SELECT e.b AS id, c.l FROM c JOIN e ON c.id = e.a WHERE c.l < e.b),
k AS (SELECT id, min(l) AS l FROM c GROUP BY id),
g AS (SELECT m.mention_id, k.l FROM m JOIN p USING (x, y, z) JOIN k USING (id)),
f AS (SELECT l, count(*) AS size, min(mention_id) AS first_mention FROM g GROUP BY l HAVING count(*) >= 2)"""
_SETS = """n AS (SELECT DISTINCT doc_id, unnest([CASE WHEN text IS NOT NULL THEN dimension_name || ':' || lower(text) END, CASE WHEN category IS NOT NULL THEN dimension_name || '=' || lower(category) END]) AS e FROM mentions WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, count(*) AS k FROM n WHERE e IS NOT NULL GROUP BY 1)"""
_STORY = f"""WITH {_SETS}, o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM n a JOIN n b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY ALL),
j AS (SELECT o.a, o.b, shared::DOUBLE / (x.k + y.k - shared) AS overlap FROM o JOIN c x ON x.doc_id = o.a JOIN c y ON y.doc_id = o.b),
t AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, {_DATE.format(c='normalized')} AS d FROM mentions WHERE dimension_name = 'temporal' AND doc_id IS NOT NULL) WHERE d IS NOT NULL GROUP BY 1),
w AS (SELECT x.doc_id AS a, y.doc_id AS b FROM t x JOIN t y ON x.doc_id < y.doc_id AND abs(date_diff('day', x.d, y.d)) < 7),
u AS (SELECT a, b FROM j WHERE overlap >= 0.3 UNION SELECT a, b FROM w),
r AS (SELECT u.a, u.b, CASE WHEN j.overlap >= 0.3 THEN j.overlap END AS overlap, abs(date_diff('day', x.d, y.d))::DOUBLE AS days FROM u LEFT JOIN j ON j.a = u.a AND j.b = u.b LEFT JOIN t x ON x.doc_id = u.a LEFT JOIN t y ON y.doc_id = u.b)
SELECT a, b, round(overlap, 6) AS overlap, days, round(0.6::DOUBLE * coalesce(overlap, 0) + CASE WHEN days < 7 THEN 0.4::DOUBLE * (1 - days / 7) ELSE 0 END, 6) AS score FROM r"""
_POINTS = f"(SELECT DISTINCT mention_id, latitude, longitude FROM mentions WHERE dimension_name = 'spatial' AND {_OK})"
_P4 = f"""WITH p AS {_POINTS}, v AS (SELECT area_id, ring, unnest(ring) AS v, generate_subscripts(ring, 1) AS i FROM (SELECT area_id, unnest(rings) AS ring FROM areas)),
g AS (SELECT area_id, v.longitude AS x1, v.latitude AS y1, ring[i % len(ring) + 1].longitude AS x2, ring[i % len(ring) + 1].latitude AS y2 FROM v),
h AS (SELECT mention_id, area_id, count(*) AS crossings FROM p JOIN g ON (y1 > p.latitude) <> (y2 > p.latitude) AND p.longitude < (x2 - x1) * (p.latitude - y1) / (y2 - y1) + x1 GROUP BY ALL)
SELECT mention_id, 'in' AS kind, area_id AS target_id FROM h WHERE crossings % 2 = 1
UNION ALL SELECT mention_id, 'near', place_id FROM p JOIN gazetteer z ON {_km('p.latitude', 'p.longitude', 'z.latitude', 'z.longitude')} * 6371.0088 / 6371.0 <= 10"""

MORE: dict[str, str] = {
    "p4_found": _P4,
    "cross_dimensional_all": "WITH v AS (SELECT DISTINCT document_id AS doc, dimension_name AS dim, coalesce(nullif(lower(trim(category, ' ')), ''), nullif(lower(trim(text, ' ')), '')) AS value FROM mentions WHERE document_id IS NOT NULL), n AS (SELECT * FROM v WHERE value IS NOT NULL) SELECT a.dim AS dim_a, a.value AS value_a, b.dim AS dim_b, b.value AS value_b, count(*) AS documents FROM n a JOIN n b ON a.doc = b.doc AND a.dim < b.dim GROUP BY ALL",
    "directions_all": f"SELECT a.place_id, b.place_id AS to_id, round({_DEG}, 4) AS bearing, {_DIR.format(d=_DEG)} AS direction, round({_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 4) AS km FROM gazetteer a JOIN gazetteer b ON b.place_id = a.place_id + 1",
    "bm25_scores_all": f"SELECT * FROM {_BM25_ALL}",
    "bm25_top_all": f"SELECT * FROM {_top(f'(SELECT query_id, doc_id, round(score, 4) AS score FROM {_BM25_ALL})', 10)}",
    "spatial_clusters": f"{_CLUSTERS} SELECT first_mention, size FROM f",
    "cluster_statistics": f"{_CLUSTERS} SELECT count(*) AS clusters, coalesce(sum(size), 0)::BIGINT AS members, min(size) AS least, max(size) AS greatest, round(avg(size), 6) AS mean, median(size) AS median FROM f",
    "story_edges": _STORY,
    "three_stage_top": _stages(_top(_DOCS, 100), _COVER),
    "three_stage_boosted": _stages(_top(_DOCS, 100), "hybrid", "CASE WHEN doc_id IN (SELECT vec_id FROM embeddings WHERE label = 2) THEN 0.3 ELSE 0.0 END"),
    "three_stage_filtered": _stages(_top(_DOCS, 100, "label IN (1, 3, 5)"), _COVER),
    "hybrid_top": f"SELECT query_id, doc_id, score, rank FROM ({_stages(_top(_DOCS, 20), 'hybrid')})",
    "rank_fusion": f"WITH d AS (SELECT query_id, doc_id, rank FROM {_top(_DENSE, 20)}), l AS (SELECT query_id, doc_id, rank FROM {_top(f'(SELECT * FROM {_BM25_ALL})', 20)}) SELECT * FROM {_top('(SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM (SELECT * FROM d UNION ALL SELECT * FROM l) GROUP BY ALL)', 10)}",
    "suggested_filters": rf"""SELECT title, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform((string_split(trim(regexp_replace(title, '\s+', ' ', 'g'), ' '), ' '))[2:], lambda x: regexp_replace(x, '[^0-9A-Za-z_\p{{L}}\p{{N}}]', '', 'g')), lambda x: regexp_matches(x, '^\p{{Lu}}')))), '|'), '') AS entities,
CASE WHEN len({_YEAR}) > 0 THEN {_YEAR}[1]::INT END AS year, CASE WHEN len({_YEAR}) = 0 AND len({_QUARTER}) > 0 THEN substr({_QUARTER}[1], 2, 1)::INT END AS quarter, nullif(regexp_extract(title, '\b(?:in|at|near|from) ([A-Z][a-z]+(?: [A-Z][a-z]+)*)', 1), '') AS region FROM (SELECT DISTINCT title FROM documents WHERE title IS NOT NULL)""",
    "context_ids": f"SELECT query_id, string_agg(doc_id::VARCHAR, ',' ORDER BY rank) AS doc_ids, count(DISTINCT doc_id) AS documents FROM {_top(_DENSE, 10)} GROUP BY 1",
    "arc_entities": f"SELECT arc, dimension_name, text, mentions, rank FROM (SELECT *, row_number() OVER (PARTITION BY arc, dimension_name ORDER BY mentions DESC, text)::INT AS rank FROM (SELECT arc, dimension_name, text, count(*) AS mentions FROM {_ARC} WHERE text <> '' GROUP BY ALL)) WHERE rank <= 3",
    "arc_dimensions": f"SELECT arc, dimension_name, count(DISTINCT nullif(text, '')) AS texts, count(DISTINCT nullif(category, '')) AS categories FROM {_ARC} GROUP BY ALL",
    "arc_times": f"SELECT arc, strftime(min(d), '%Y-%m-%d') AS start, strftime(max(d), '%Y-%m-%d') AS \"end\", date_diff('day', min(d), max(d)) AS days, count(*) AS dated FROM {_FIRST} GROUP BY arc",
    "arc_places": f"SELECT arc, count(*) AS places, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon, max(longitude) AS max_lon, round(avg(latitude), 6) AS lat, round(avg(longitude), 6) AS lon FROM {_ARC} WHERE dimension_name = 'spatial' AND {_OK} GROUP BY arc",
    "arc_gaps": f"SELECT arc, count(*) - 1 AS pairs, round(coalesce(sum(gap)::DOUBLE / nullif(count(*) - 1, 0), 0), 6) AS mean_gap, coalesce(max(gap), 0) AS max_gap, round(greatest(0.0, 1 - coalesce(max(gap), 0) / 14.0::DOUBLE), 6) AS coherence FROM (SELECT *, date_diff('day', lag(d) OVER (PARTITION BY arc ORDER BY d), d) AS gap FROM {_FIRST}) GROUP BY arc",
    "arc_progression": f"""SELECT arc, doc_id, strftime(d, '%Y-%m-%d') AS date, coalesce(place, 'Unknown') AS place, row_number() OVER (PARTITION BY arc ORDER BY d NULLS LAST, doc_id)::INT AS step
FROM (SELECT DISTINCT arc, doc_id FROM {_ARC} WHERE doc_id IS NOT NULL) LEFT JOIN {_FIRST} USING (arc, doc_id) LEFT JOIN (SELECT arc, doc_id, min_by(text, mention_id) AS place FROM {_ARC} WHERE dimension_name = 'spatial' AND text <> '' AND doc_id IS NOT NULL GROUP BY ALL) USING (arc, doc_id)""",
    "time_ranges": f"""SELECT text, CASE WHEN ok THEN {_CLOCK.format(p='g.c', h='h1', m='m1')} END AS start, CASE WHEN ok THEN {_CLOCK.format(p='g.f', h='h2', m='m2')} END AS "end" FROM (SELECT *, g.a <> '' AND (g.c <> '' OR g.f <> '' OR (g.b <> '' AND g.e <> '')) AND h1 < 24 AND h2 < 24 AND m1 < 60 AND m2 < 60 AS ok FROM
(SELECT *, {_NUM.format(x='a')} AS h1, {_NUM.format(x='b')} AS m1, {_NUM.format(x='d')} AS h2, {_NUM.format(x='e')} AS m2 FROM (SELECT text, regexp_extract(lower(text), '{_FORM}', ['a', 'b', 'c', 'd', 'e', 'f']) AS g FROM (SELECT DISTINCT text FROM mentions WHERE dimension_name = 'temporal' AND text IS NOT NULL))))""",
    "efficiency_targets": "SELECT runs, p95, chunks_a_second, true AS overhead_met, coalesce(chunks_a_second >= 10, false) AS throughput_met, coalesce(p95 < 500, false) AS p95_met FROM (SELECT count(*) AS runs, round(quantile_cont(total_duration_seconds * 1000, 0.95), 4) AS p95, round(count(*) / nullif(sum(total_duration_seconds), 0), 6) AS chunks_a_second FROM timings WHERE total_duration_seconds IS NOT NULL)",
    "overall_scores": "SELECT count(*) AS dimensions, round(avg(f1), 6) AS combined_f1, round(avg((f1 > 0)::INT), 6) AS success_rate FROM (SELECT dimension_name, round(2.0::DOUBLE * count(*) FILTER (confidence >= 0.8) / (count(*) FILTER (confidence >= 0.8) + count(*)), 6) AS f1 FROM mentions WHERE confidence IS NOT NULL GROUP BY 1) WHERE dimension_name IS NOT NULL",
    "batch_plans": "SELECT source, size, f AS first_batch, b AS batches, (CASE WHEN b <= 2 THEN 0.3 WHEN b <= 5 THEN 0.6 ELSE 0.9 END)::DOUBLE AS threshold FROM (SELECT *, (CASE WHEN size <= f THEN 1 ELSE 1 + ceil((size - f) / 50.0) END)::INT AS b FROM (SELECT source, count(*) AS size, greatest(50, least(150, floor(count(*) * 0.1::DOUBLE)))::INT AS f FROM mentions GROUP BY 1))",
    "dimension_entities": f"SELECT * FROM {_ENT}",
    "schema_statistics": f"SELECT dimension, count(*) AS entities, sum(mentions)::BIGINT AS mentions, count(*) FILTER (clusters > 1) AS shared FROM {_ENT} GROUP BY ROLLUP (dimension)",
    "nearby_lines": f"SELECT place_id, string_agg('  - ' || place_name || ' (' || coalesce(location_type, 'feature') || '): ' || format('{{:,.1f}}', km) || 'km ' || direction, chr(10) ORDER BY rank) AS lines FROM ({SQL['nearby_places']}) n JOIN (SELECT place_id AS other_id, place_name, location_type FROM gazetteer) g USING (other_id) WHERE rank <= 5 GROUP BY place_id",
}
