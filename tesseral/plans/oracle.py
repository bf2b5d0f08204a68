"""The same results as SQL for another engine, written from the operators' semantics."""

from __future__ import annotations

# what several statements share
_START = "split_part({c}, '/', 1)"
_DATE = "(CASE WHEN regexp_matches(split_part({c}, '/', 1), '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}($|[T ])') THEN TRY_CAST(substr(split_part({c}, '/', 1), 1, 10) AS DATE) END)"
_OK = "coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 AND NOT (latitude = 0 AND longitude = 0), false)"
_TIMES = f"(SELECT *, {_DATE.format(c='normalized')} AS d FROM mentions WHERE dimension_name = 'temporal')"


def _km(a1: str, o1: str, a2: str, o2: str) -> str:
    h = f"(pow(sin((radians({a2}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin((radians({o2}) - radians({o1})) / 2), 2))"
    return f"(12742.0 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - {h}))))"


_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_TOK = "list_filter(string_split(" + _NORM + ", ' '), lambda x: x <> '')"
_IDS_T = f"SELECT DISTINCT document_id FROM {_TIMES} WHERE year(d) = 2022 AND quarter(d) = 2 AND document_id IS NOT NULL"
_IDS_B = f"SELECT DISTINCT document_id FROM mentions WHERE dimension_name = 'spatial' AND longitude BETWEEN -60 AND 60 AND latitude BETWEEN -40 AND 40 AND {_OK} AND document_id IS NOT NULL"
_IDS_L = "SELECT DISTINCT document_id FROM mentions WHERE dimension_name = 'event_type' AND lower(trim(category, ' ')) IN ('flood', 'bushfire') AND document_id IS NOT NULL"
_POSTINGS = """(WITH h AS (SELECT c_custkey AS doc_id, lower(r_name) AS r, lower(n_name) AS n, lower(c_mktsegment) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT DISTINCT * FROM (SELECT 'place' AS dim, 'label' AS kind, r AS key, doc_id FROM h UNION ALL SELECT 'place', 'label', n, doc_id FROM h UNION ALL SELECT 'place', 'path', r || ' > ' || n, doc_id FROM h
UNION ALL SELECT 'segment', 'label', lower(c_mktsegment), c_custkey FROM customer UNION ALL SELECT 'segment', 'path', lower(c_mktsegment), c_custkey FROM customer))"""
_V = "(SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings)"
_DENSE = f"(SELECT q.vec_id AS query_id, v.vec_id AS doc_id, round(list_inner_product(q.e, v.e), 6) AS score, v.label AS label FROM {_V} q, {_V} v WHERE q.vec_id % 20 = 0)"


def _top(src: str, k: int, where: str = "true") -> str:
    return f"(SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM {src} WHERE {where}) WHERE rank <= {k})"


_DAILY = """WITH b AS (SELECT time_bucket(INTERVAL '{i}', ts) AS bin, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1),
f AS (SELECT g.bin, coalesce(b.n, 0) AS events FROM (SELECT unnest(generate_series((SELECT min(bin) FROM b), (SELECT max(bin) FROM b), INTERVAL '{i}')) AS bin) g LEFT JOIN b ON b.bin = g.bin),
m AS (SELECT avg(events) AS mean, stddev_samp(events) AS sd FROM f)
SELECT strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, events, round(mean + {k} * sd, 6) AS threshold, round((events - mean) / sd, 6) AS intensity FROM f, m WHERE events > mean + {k} * sd"""
_ENRICHED = f"""(WITH t AS (SELECT document_id, min_by({{'d': d, 'text': text}}, mention_id) AS t FROM {_TIMES} WHERE d IS NOT NULL AND document_id IS NOT NULL GROUP BY 1),
s AS (SELECT document_id, min_by({{'text': text, 'a': latitude, 'o': longitude, 'l': location_type}}, mention_id) AS s FROM mentions WHERE dimension_name = 'spatial' AND {_OK} AND document_id IS NOT NULL GROUP BY 1)
SELECT coalesce(t.document_id, s.document_id) AS document_id, strftime(t.t.d, '%Y-%m-%d') AS temporal_normalized, year(t.t.d)::INT AS temporal_year, quarter(t.t.d)::INT AS temporal_quarter, month(t.t.d)::INT AS temporal_month, t.t.text AS temporal_text,
s.s.text AS spatial_text, s.s.a AS latitude, s.s.o AS longitude, s.s.l AS location_type FROM t FULL JOIN s ON t.document_id = s.document_id)"""
_FLAT = f"""(WITH t AS (SELECT DISTINCT doc_id, strftime(d, '%Y-%m-%d') AS date, text AS time_text FROM {_TIMES} WHERE d IS NOT NULL AND doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, text AS place, latitude, longitude FROM mentions WHERE dimension_name = 'spatial' AND {_OK} AND doc_id IS NOT NULL)
SELECT coalesce(t.doc_id, s.doc_id) AS doc_id, date, time_text, place, latitude, longitude FROM t FULL JOIN s ON t.doc_id = s.doc_id)"""
_QUERIES = "(SELECT * FROM (VALUES (1::BIGINT, 'river flood warning'), (2::BIGINT, 'measles cases confirmed by the hospital'), (3::BIGINT, 'storm moved towards the levee')) AS v(query_id, query))"
_BM25 = rf"""(WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ts FROM documents WHERE text IS NOT NULL),
st AS (SELECT count(*) AS docs, avg(len(ts)) AS mean_len FROM d),
q AS (SELECT query_id, unnest(string_split(query, ' ')) AS t FROM {_QUERIES}),
a AS (SELECT doc_id, len(ts) AS l, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY ALL),
p AS (SELECT * FROM a WHERE t IN (SELECT t FROM q)),
i AS (SELECT t, ln((any_value(docs) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM a, st GROUP BY t),
f AS (SELECT t, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM i) ELSE idf END AS idf FROM i)
SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * l / mean_len))), 6) AS score FROM p JOIN f USING (t) JOIN q USING (t), st GROUP BY query_id, doc_id)"""
_CHUNK = r"regexp_extract(doc_id, '_chunk_(\d+)$', 1)"
_ANSWERS = "(SELECT a.document_id AS question_id, a.title AS predicted, b.title AS gold, b.content AS context FROM (SELECT DISTINCT document_id, title FROM input_documents WHERE title IS NOT NULL) a JOIN (SELECT DISTINCT document_id, title, content FROM parsed_documents) b ON a.document_id = b.document_id WHERE b.title IS NOT NULL)"
_F1 = f"""(WITH t AS (SELECT *, {_TOK.format(c='predicted')} AS p, {_TOK.format(c='gold')} AS g, {_TOK.format(c='context')} AS c FROM {_ANSWERS}),
o AS (SELECT *, coalesce(list_sum(list_transform(list_distinct(p), lambda x: least(len(list_filter(p, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))), 0)::DOUBLE AS n FROM t)
SELECT question_id, ({_NORM.format(c='predicted')} = {_NORM.format(c='gold')})::INT AS exact_match,
round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE n / len(p) END, 6) AS precision,
round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE n / len(g) END, 6) AS recall,
round(CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0 WHEN n = 0 THEN 0.0 ELSE 2 * n / (len(p) + len(g)) END, 6) AS f1,
round(CASE WHEN context IS NULL THEN NULL WHEN len(g) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(g), c))::DOUBLE / len(list_distinct(g)) END, 6) AS coverage FROM o)"""
_RET_TERMS = ", ".join(
    f"round(sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)::DOUBLE / any_value(rel), 6) AS recall_{k}, round(coalesce(sum(CASE WHEN rank <= {k} THEN hit ELSE 0 END)::DOUBLE / nullif(sum(CASE WHEN rank <= {k} THEN 1 ELSE 0 END), 0), 0), 6) AS precision_{k}, "
    f"round(sum(CASE WHEN rank <= {k} THEN hit / log2(rank + 1) ELSE 0 END) / list_sum(list_transform(generate_series(1, least({k}, any_value(rel))), lambda i: 1 / log2(i + 1))), 6) AS ndcg_{k}"
    for k in (1, 5, 10, 20)
)
_RETRIEVAL = f"""(WITH r AS (SELECT query_id, doc_id, rank FROM {_top(_DENSE, 20)}), rel AS (SELECT q.vec_id AS query_id, v.vec_id AS doc_id FROM {_V} q JOIN {_V} v USING (label) WHERE q.vec_id % 20 = 0),
n AS (SELECT query_id, count(*) AS rel FROM rel GROUP BY 1), h AS (SELECT r.*, (rel.doc_id IS NOT NULL)::INT AS hit FROM r LEFT JOIN rel ON r.query_id = rel.query_id AND r.doc_id = rel.doc_id)
SELECT n.query_id, round(coalesce(1.0 / min(CASE WHEN hit = 1 THEN rank END), 0), 6) AS reciprocal_rank, {_RET_TERMS} FROM n JOIN h ON n.query_id = h.query_id GROUP BY n.query_id)"""
_METERS = "SELECT round({km}, 6) AS km FROM mentions m JOIN gazetteer g ON lower(m.text) = lower(g.place_name) WHERE dimension_name = 'spatial' AND coalesce(m.latitude BETWEEN -90 AND 90 AND m.longitude BETWEEN -180 AND 180 AND NOT (m.latitude = 0 AND m.longitude = 0), false)".format(km=_km("m.latitude", "m.longitude", "g.latitude", "g.longitude"))
_DEG = "((degrees(atan2(sin(radians(b.longitude) - radians(a.longitude)) * cos(radians(b.latitude)), cos(radians(a.latitude)) * sin(radians(b.latitude)) - sin(radians(a.latitude)) * cos(radians(b.latitude)) * cos(radians(b.longitude) - radians(a.longitude)))) + 360) % 360)"
_DIR = "(['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[(round_even({d} / 45, 0)::INT % 8) + 1]"
_MEAN = "round(avg({c}), 4) AS {n}"

SQL: dict[str, str] = {
    "temporal_ids": _IDS_T,
    "temporal_range_ids": f"SELECT DISTINCT document_id FROM {_TIMES} WHERE d BETWEEN DATE '2022-03-01' AND DATE '2022-06-30' AND document_id IS NOT NULL",
    "bbox_ids": _IDS_B,
    "radius_ids": f"SELECT DISTINCT document_id FROM mentions WHERE dimension_name = 'spatial' AND {_OK} AND {_km('latitude', 'longitude', '10.0', '20.0')} <= 2500 AND document_id IS NOT NULL",
    "any_ids": _IDS_L,
    "all_ids": "SELECT document_id FROM mentions WHERE dimension_name = 'event_type' AND lower(trim(category, ' ')) IN ('flood', 'bushfire') AND document_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lower(trim(category, ' '))) = 2",
    "and_ids": f"({_IDS_T}) INTERSECT ({_IDS_B}) INTERSECT ({_IDS_L})",
    "or_ids": f"({_IDS_T}) UNION ({_IDS_B}) UNION ({_IDS_L})",
    "filter_stats": f"SELECT 'temporal' AS filter, count(*) AS matches FROM ({_IDS_T}) UNION ALL SELECT 'spatial', count(*) FROM ({_IDS_B}) UNION ALL SELECT 'label', count(*) FROM ({_IDS_L}) UNION ALL SELECT 'combined', count(*) FROM (({_IDS_T}) INTERSECT ({_IDS_B}) INTERSECT ({_IDS_L}))",
    "dimension_postings": f"SELECT dim, kind, key, count(*) AS docs FROM {_POSTINGS} GROUP BY ALL",
    "hierarchical_ids": f"SELECT doc_id FROM {_POSTINGS} WHERE dim = 'place' AND ((kind = 'label' AND key IN ('asia', 'europe > g')) OR (kind = 'path' AND (contains(key, 'asia') OR contains(key, 'europe > g')))) INTERSECT SELECT doc_id FROM {_POSTINGS} WHERE dim = 'segment' AND ((kind = 'label' AND key = 'building') OR (kind = 'path' AND contains(key, 'building')))",
    "dimension_top": f"SELECT dim, key, docs, rank FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY docs DESC, key)::INT AS rank FROM (SELECT dim, key, count(DISTINCT doc_id) AS docs FROM {_POSTINGS} WHERE kind = 'label' GROUP BY ALL)) WHERE rank <= 50",
    "available_keys": f"SELECT DISTINCT dim, kind, key FROM {_POSTINGS}",
    "category_validation": "SELECT mention_id, coalesce(r.category, 'unknown') AS category, round(CASE WHEN r.category = m.category THEN coalesce(category_confidence, 1.0) WHEN r.category IS NOT NULL THEN coalesce(category_confidence, 1.0) * 0.9 ELSE 0.0 END, 6) AS category_confidence, CASE WHEN r.category = m.category THEN 'exact' WHEN r.category IS NOT NULL THEN 'corrected' ELSE 'invalid' END AS status FROM (SELECT DISTINCT mention_id, dimension_name, category, category_confidence FROM mentions WHERE category IS NOT NULL) m LEFT JOIN category_ref r ON r.dimension_name = m.dimension_name AND lower(trim(r.category, ' ')) = lower(trim(m.category, ' '))",
    "temporal_stats": f"SELECT count(*) AS total, count(DISTINCT d) AS unique_dates, strftime(min(d), '%Y-%m-%d') AS first_date, strftime(max(d), '%Y-%m-%d') AS last_date, coalesce(max(d) - min(d), 0)::BIGINT AS span_days FROM {_TIMES} WHERE d IS NOT NULL",
    "temporal_distribution": f"SELECT kind, key, count(*) AS mentions FROM (SELECT unnest([{{'kind': 'year', 'key': year(d)::VARCHAR}}, {{'kind': 'month', 'key': month(d)::VARCHAR}}, {{'kind': 'weekday', 'key': (isodow(d) - 1)::VARCHAR}}, {{'kind': 'type', 'key': coalesce(normalization_type, 'unknown')}}, {{'kind': 'source', 'key': coalesce(source, 'unknown')}}], recursive := true) FROM {_TIMES} WHERE d IS NOT NULL) GROUP BY ALL",
    "temporal_timeline": f"SELECT strftime(d, '%Y-%m-%d') AS date, count(*) AS mentions, count(DISTINCT document_id) AS documents FROM {_TIMES} WHERE d IS NOT NULL GROUP BY 1",
    "spatial_stats": f"SELECT count(*) AS total, count(DISTINCT text) AS unique_texts, round(avg(ok::INT), 6) AS located_share, round(min(a), 6) AS min_lat, round(max(a), 6) AS max_lat, round(min(o), 6) AS min_lon, round(max(o), 6) AS max_lon, round(avg(a), 6) AS center_lat, round(avg(o), 6) AS center_lon FROM (SELECT text, {_OK} AS ok, CASE WHEN {_OK} THEN latitude END AS a, CASE WHEN {_OK} THEN longitude END AS o FROM mentions WHERE dimension_name = 'spatial')",
    "top_texts": "SELECT dimension_name, text, mentions, rank FROM (SELECT *, row_number() OVER (PARTITION BY dimension_name ORDER BY mentions DESC, text)::INT AS rank FROM (SELECT dimension_name, text, count(*) AS mentions FROM mentions WHERE text IS NOT NULL GROUP BY ALL)) WHERE rank <= 20",
    "category_stats": "SELECT dimension_name, category, count(*) AS mentions, count(DISTINCT document_id) AS documents, round(avg(category_confidence), 6) AS confidence FROM mentions WHERE category IS NOT NULL GROUP BY ALL",
    "category_by_source": "SELECT dimension_name, source, category, count(*) AS mentions FROM mentions WHERE category IS NOT NULL AND source IS NOT NULL GROUP BY ALL",
    "cross_dimensional": "WITH v AS (SELECT DISTINCT document_id AS doc, dimension_name AS dim, lower(trim(category, ' ')) AS value FROM mentions WHERE dimension_name IN ('event_type', 'disease', 'organization') AND document_id IS NOT NULL AND category IS NOT NULL) SELECT a.dim AS dim_a, a.value AS value_a, b.dim AS dim_b, b.value AS value_b, count(*) AS documents FROM v a JOIN v b ON a.doc = b.doc AND a.dim < b.dim GROUP BY ALL",
    "global_stats": "WITH c AS (SELECT DISTINCT doc_id, coalesce(document_metadata['source'], 'unknown') AS source FROM document_chunks), h AS (SELECT DISTINCT doc_id FROM mentions WHERE doc_id IS NOT NULL), j AS (SELECT c.*, h.doc_id IS NOT NULL AS hit FROM c LEFT JOIN h ON c.doc_id = h.doc_id) SELECT 'chunks' AS kind, 'all' AS key, count(*) AS n FROM j UNION ALL SELECT 'chunks', 'with_mentions', count(*) FROM j WHERE hit UNION ALL SELECT 'chunks', 'without_mentions', count(*) FROM j WHERE NOT hit UNION ALL SELECT 'dimension', dimension_name, count(*) FROM mentions GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM j GROUP BY 2",
    "document_summary": "SELECT document_id, count(*) FILTER (dimension_name = 'temporal') AS temporal, count(*) FILTER (dimension_name = 'spatial') AS spatial, count(*) FILTER (dimension_name NOT IN ('temporal', 'spatial')) AS other, count(*) AS mentions, round(avg(confidence), 6) AS confidence FROM mentions WHERE document_id IS NOT NULL GROUP BY 1",
    "burst_days": _DAILY.format(i="1 day", k="1.0"),
    "burst_hours": _DAILY.format(i="1 hour", k="2.0"),
    "temporal_clusters": "WITH m AS (SELECT DISTINCT mention_id, TRY_CAST(replace(s, 'T', ' ') AS TIMESTAMP) AS ts FROM (SELECT mention_id, regexp_replace(split_part(normalized, '/', 1), '[zZ]$', '') AS s FROM mentions WHERE dimension_name = 'temporal') WHERE regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\\.[0-9]{1,6})?)?$')), n AS (SELECT *, (ts - lag(ts) OVER (ORDER BY ts) > INTERVAL 24 HOUR)::INT AS new FROM m WHERE ts IS NOT NULL), c AS (SELECT *, sum(coalesce(new, 0)) OVER (ORDER BY ts) AS c FROM n) SELECT min(mention_id) AS first_mention, count(*) AS size FROM c GROUP BY c HAVING count(*) >= 2",
    "categorical_clusters": "SELECT dimension_name, category, count(*) AS size, count(DISTINCT document_id) AS documents FROM mentions WHERE category IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
    "flat_events": f"SELECT * FROM {_FLAT}",
    "enriched_documents": f"SELECT * FROM {_ENRICHED}",
    "inverted_index": f"SELECT kind, key, count(DISTINCT document_id) AS documents FROM (SELECT document_id, unnest([{{'kind': 'year', 'key': temporal_year::VARCHAR}}, {{'kind': 'quarter', 'key': 'Q' || temporal_quarter}}, {{'kind': 'month', 'key': substr(temporal_normalized, 1, 7)}}, {{'kind': 'place', 'key': lower(spatial_text)}}], recursive := true) FROM {_ENRICHED}) WHERE key IS NOT NULL GROUP BY ALL",
    "dense_top": f"SELECT * FROM {_top(_DENSE, 10)}",
    "pre_filter_top": f"SELECT * FROM {_top(_DENSE, 10, 'label IN (1, 3, 5)')}",
    "post_filter_top": f"SELECT * FROM {_top(f'(SELECT t.query_id, t.doc_id, t.score FROM {_top(_DENSE, 30)} t JOIN {_V} v ON v.vec_id = t.doc_id WHERE v.label IN (1, 3, 5))', 10)}",
    "bm25_scores": f"SELECT * FROM {_BM25}",
    "bm25_top": f"SELECT * FROM {_top(f'(SELECT query_id, doc_id, round(score, 4) AS score FROM {_BM25})', 10)}",
    "boosted_top": f"SELECT * FROM {_top(f'(SELECT t.query_id, t.doc_id, round(t.score + CASE WHEN v.label = 2 THEN 0.3 ELSE 0 END, 6) AS score FROM {_top(_DENSE, 30)} t JOIN {_V} v ON v.vec_id = t.doc_id)', 10)}",
    "nearby_places": f"SELECT place_id, other_id, km, {_DIR.format(d='deg')} AS direction, rank FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY km, other_id)::INT AS rank FROM (SELECT a.place_id, b.place_id AS other_id, round({_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 2) AS km, {_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS raw, {_DEG} AS deg FROM gazetteer a, gazetteer b WHERE a.place_id <> b.place_id) WHERE raw BETWEEN 0.1 AND 500) WHERE rank <= 10",
    "geocoded": f"WITH g AS (SELECT lower(place_name) AS name, min_by({{'a': latitude, 'o': longitude}}, place_id) AS g FROM gazetteer GROUP BY 1), m AS (SELECT DISTINCT mention_id, text, {_OK} AS ok, latitude, longitude FROM mentions WHERE dimension_name = 'spatial' AND text IS NOT NULL) SELECT mention_id, CASE WHEN ok THEN latitude ELSE coalesce(f.g.a, c.g.a) END AS latitude, CASE WHEN ok THEN longitude ELSE coalesce(f.g.o, c.g.o) END AS longitude, CASE WHEN ok THEN 'own' WHEN f.g IS NOT NULL THEN 'name' WHEN c.g IS NOT NULL THEN 'city' ELSE 'none' END AS found FROM m LEFT JOIN g f ON f.name = lower(trim(text)) LEFT JOIN g c ON c.name = lower(trim(split_part(text, ',', 1)))",
    "content_copies": "SELECT substr(md5(text), 1, 12) AS content_id, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text <> '' GROUP BY 1",
    "merged_ids": "SELECT document_id, min(r)::INT AS first_table, count(DISTINCT r) AS tables FROM (SELECT document_id, 1 AS r FROM parsed_documents UNION ALL SELECT document_id, 2 FROM input_documents) GROUP BY 1",
    "unfinished_documents": "SELECT DISTINCT document_id FROM input_documents WHERE document_id NOT IN (SELECT document_id FROM parsed_documents WHERE document_id IS NOT NULL)",
    "normalised_answers": f"SELECT DISTINCT title, {_NORM.format(c='title')} AS answer FROM parsed_documents WHERE title IS NOT NULL",
    "qa_rows": f"SELECT * FROM {_F1}",
    "qa_summary": f"SELECT *, exact_match >= 0.4 AND token_f1 >= 0.55 AND coverage >= 0.8 AS meets_targets FROM (SELECT count(*) AS questions, round(avg(exact_match), 4) AS exact_match, round(avg(f1), 4) AS token_f1, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(coverage), 4) AS coverage FROM {_F1})",
    "retrieval_rows": f"SELECT * FROM {_RETRIEVAL}",
    "retrieval_summary": "SELECT *, recall_10 >= 0.7 AND precision_10 >= 0.6 AND mrr >= 0.6 AS meets_targets FROM (SELECT count(*) AS queries, round(avg(reciprocal_rank), 4) AS mrr, " + ", ".join(f"round(avg({m}_{k}), 4) AS {m}_{k}" for k in (1, 5, 10, 20) for m in ("recall", "precision", "ndcg")) + f" FROM {_RETRIEVAL})",
    "extraction_counts": "WITH m AS (SELECT document_id, dimension_name, lower(text) AS text, confidence, normalized IS NOT NULL OR category IS NOT NULL AS sure FROM mentions WHERE text IS NOT NULL AND document_id IS NOT NULL), c AS (SELECT document_id, dimension_name, text, count(*) FILTER (confidence >= 0.8) AS p, count(*) FILTER (sure) AS t FROM m GROUP BY ALL), s AS (SELECT sum(least(p, t))::BIGINT AS tp, sum(p)::BIGINT AS p, sum(t)::BIGINT AS t FROM c) SELECT tp, p - tp AS fp, t - tp AS fn, round(tp::DOUBLE / p, 6) AS precision, round(tp::DOUBLE / t, 6) AS recall, round(2.0::DOUBLE * tp / (p + t), 6) AS f1 FROM s",
    "distance_accuracy": f"SELECT count(*) AS pairs, round(avg(km), 4) AS mean_km, round(quantile_cont(km, 0.5), 4) AS median_km, round(avg((km <= 25)::INT), 6) AS near, round(avg((km > 25 AND km <= 200)::INT), 6) AS middle, round(avg((km > 200)::INT), 6) AS far FROM ({_METERS})",
    "latency": "SELECT count(*) AS runs, round(quantile_cont(s * 1000, 0.5), 4) AS p50, round(quantile_cont(s * 1000, 0.95), 4) AS p95, round(quantile_cont(s * 1000, 0.99), 4) AS p99, round(avg(s * 1000), 4) AS mean, round(stddev_pop(s * 1000), 4) AS deviation, round(count(*) / sum(s), 6) AS chunks_a_second, round(sum(gpu_hours), 4) AS gpu_hours FROM (SELECT total_duration_seconds AS s, gpu_hours FROM timings WHERE total_duration_seconds IS NOT NULL)",
    "component_times": "WITH c AS (SELECT unnest(map_entries(components)) AS e FROM timings WHERE components IS NOT NULL), a AS (SELECT e.key AS component, '' AS part, e.value.duration_seconds AS s FROM c UNION ALL SELECT component, i.key, i.value FROM (SELECT e.key AS component, unnest(map_entries(e.value.components)) AS i FROM c WHERE e.value.components IS NOT NULL)) SELECT component, part, count(*) AS runs, round(sum(s), 4) AS total, round(avg(s), 6) AS mean, min(s) AS least, max(s) AS greatest FROM a WHERE s IS NOT NULL GROUP BY ALL",
    "duration_correlation": "SELECT count(*) AS pairs, round(corr(total_duration_seconds, gpu_hours), 6) AS r FROM timings WHERE total_duration_seconds IS NOT NULL AND gpu_hours IS NOT NULL",
    "resolved_phrases": f"WITH a AS (SELECT DISTINCT document_id, {_DATE.format(c='date')} AS d FROM parsed_documents) SELECT document_id, phrase, CASE phrase WHEN 'yesterday' THEN strftime(d - 1, '%Y-%m-%d') WHEN 'next week' THEN strftime(d + 7, '%Y-%m-%d') WHEN 'on Friday' THEN strftime(d - ((isodow(d) - 5 + 7) % 7)::INT, '%Y-%m-%d') WHEN '2022-03-15' THEN '2022-03-15' WHEN 'last month' THEN strftime(d - 30, '%Y-%m-%d') END AS resolved FROM a, (VALUES ('yesterday'), ('next week'), ('on Friday'), ('2022-03-15'), ('last month'), ('soon')) AS p(phrase) WHERE d IS NOT NULL",
    "time_parts": f"SELECT DISTINCT mention_id, year(d)::INT AS year, quarter(d)::INT AS quarter, month(d)::INT AS month FROM {_TIMES} WHERE d IS NOT NULL",
    "directions": f"SELECT a.place_id, b.place_id AS to_id, round({_DEG}, 4) AS bearing, {_DIR.format(d=_DEG)} AS direction, round({_km('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')}, 4) AS km FROM gazetteer a JOIN gazetteer b ON b.place_id = a.place_id + 1 WHERE a.place_id % 2 = 0",
    "yearly_rollup": f"SELECT year(d)::INT AS year, coalesce(source, 'none') AS source, count(*) AS mentions, 0::BIGINT AS level FROM {_TIMES} WHERE d IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT year(d)::INT, NULL, count(*), 1 FROM {_TIMES} WHERE d IS NOT NULL GROUP BY 1 UNION ALL SELECT NULL, NULL, count(*), 3 FROM {_TIMES} WHERE d IS NOT NULL",
    "event_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts), '%Y-%m-%d %H:%M:%S') AS bin, event_type, count(*) AS events, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "event_sessions": "WITH n AS (SELECT user_id, ts, (ts - lag(ts) OVER w >= INTERVAL 4 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), c AS (SELECT *, sum(coalesce(new, 0)) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM n) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS events FROM c GROUP BY user_id, c",
    "context_memory": rf"WITH m AS (SELECT DISTINCT document_id, dimension_name, {_CHUNK} AS i, mention_id, text FROM mentions WHERE doc_id IS NOT NULL AND document_id IS NOT NULL AND text IS NOT NULL AND {_CHUNK} <> ''), n AS (SELECT document_id, dimension_name, i::INT AS chunk_index, mention_id, text FROM m), k AS (SELECT DISTINCT document_id, dimension_name, chunk_index FROM n), r AS (SELECT k.*, n.text, row_number() OVER (PARTITION BY k.document_id, k.dimension_name, k.chunk_index ORDER BY n.chunk_index DESC, n.mention_id DESC, n.text DESC) AS r FROM k JOIN n ON n.document_id = k.document_id AND n.dimension_name = k.dimension_name AND n.chunk_index < k.chunk_index), s AS (SELECT document_id, dimension_name, chunk_index, count(*) AS seen, string_agg(text, '; ' ORDER BY r DESC) FILTER (r <= 10) AS refs FROM r GROUP BY ALL) SELECT k.document_id, k.dimension_name, k.chunk_index, coalesce(seen, 0) AS seen, coalesce(refs, '') AS refs FROM k LEFT JOIN s USING (document_id, dimension_name, chunk_index)",
    "anchor_dates": rf"WITH m AS (SELECT DISTINCT document_id, {_CHUNK} AS i, mention_id, CASE WHEN dimension_name = 'temporal' THEN {_DATE.format(c='normalized')} END AS d FROM mentions WHERE doc_id IS NOT NULL AND document_id IS NOT NULL AND {_CHUNK} <> ''), k AS (SELECT DISTINCT document_id, i::INT AS chunk_index FROM m), r AS (SELECT k.document_id, k.chunk_index, arg_max(m.d, (m.i::INT, m.mention_id)) AS d FROM k JOIN m ON m.document_id = k.document_id AND m.i::INT < k.chunk_index AND m.d IS NOT NULL GROUP BY ALL), o AS (SELECT document_id, min({_DATE.format(c='date')}) AS own FROM parsed_documents GROUP BY 1) SELECT k.document_id, k.chunk_index, strftime(coalesce(r.d, o.own), '%Y-%m-%d') AS anchor FROM k LEFT JOIN r USING (document_id, chunk_index) LEFT JOIN o ON o.document_id = k.document_id",
    "keywords": "WITH w AS (SELECT doc_id, unnest(ws) AS keyword, generate_subscripts(ws, 1) AS pos FROM (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: regexp_full_match(x, '[a-z]{4,}')) AS ws FROM document_chunks WHERE text IS NOT NULL)), c AS (SELECT doc_id, keyword, count(*) AS n, min(pos) AS f FROM w WHERE keyword NOT IN ({stop}) GROUP BY ALL) SELECT doc_id, keyword, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f)::INT AS rank FROM c) WHERE rank <= 6",
    "confidence_rollup": "SELECT dimension_name, tp, fp, fn, round(CASE WHEN tp > 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0::DOUBLE * tp / (2 * tp + fn), 6) AS f1 FROM (SELECT dimension_name, count(*) FILTER (confidence >= 0.8) AS tp, 0::BIGINT AS fp, count(*) FILTER (confidence < 0.8) AS fn FROM mentions WHERE confidence IS NOT NULL GROUP BY ROLLUP (dimension_name))",
    "schema_mentions": "SELECT DISTINCT mention_id, dimension_name, text FROM mentions WHERE dimension_name IN ('temporal', 'spatial') AND trim(text, ' ') <> ''",
    "latency_improvement": "WITH l AS (SELECT num_gpus > 1 AS many, round(quantile_cont(total_duration_seconds * 1000, 0.5), 4) AS p50, round(quantile_cont(total_duration_seconds * 1000, 0.95), 4) AS p95, round(avg(total_duration_seconds * 1000), 4) AS mean FROM timings WHERE total_duration_seconds IS NOT NULL AND num_gpus >= 1 GROUP BY 1), u AS (SELECT a.many, unnest([{'m': 'p50', 'v': p50}, {'m': 'p95', 'v': p95}, {'m': 'mean', 'v': mean}]) AS x FROM l a) SELECT b.x.m AS measure, b.x.v AS baseline, o.x.v AS other, round(o.x.v - b.x.v, 6) AS change, round(100 * (o.x.v - b.x.v) / abs(b.x.v), 4) AS percent FROM u b JOIN u o ON b.x.m = o.x.m WHERE NOT b.many AND o.many",
    "distinct_entities": r"SELECT dimension, key, count(DISTINCT text) AS variants, count(*) AS mentions FROM (SELECT dimension_name AS dimension, lower(regexp_replace(text, '[^\p{L}\p{N}]+', '', 'g')) AS key, text FROM mentions WHERE text IS NOT NULL) WHERE key <> '' GROUP BY ALL",
    "query_kinds": "SELECT DISTINCT title, regexp_replace(trim(regexp_replace('What happened in ' || title || ' during 2022??', '\\s+', ' ', 'g')), '\\?+$', '') AS query, 'temporal' AS kind, '2022' AS years FROM documents WHERE title IS NOT NULL",
    "input_ids": "SELECT 'text_' || substr(md5(text), 1, 12) AS document_id, min(CASE WHEN length(trim(text, ' ')) > 50 THEN substr(trim(text, ' '), 1, 50) || '...' ELSE trim(text, ' ') END) AS title, count(*) AS n FROM documents WHERE trim(text, ' ') <> '' GROUP BY 1",
}


def _stop_words() -> str:
    from tesseral.functions.columns import STOP_WORDS

    return ", ".join(f"'{w}'" for w in STOP_WORDS)


SQL["keywords"] = SQL["keywords"].replace("{stop}", _stop_words())
