"""The views of ``views.py`` as DuckDB common table expressions, for the side-by-side check."""

TOK = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"


def tok(x: str) -> str:
    return TOK.format(x)


LETTERS = r"\p{L}\p{N}\p{M}\s"
VIEWS = {
    "v_cues": f"""
        SELECT session_id, cue_no, speaker, text, CAST(e - dur AS BIGINT) AS start_ms, CAST(e AS BIGINT) AS end_ms
        FROM (SELECT *, sum(dur) OVER (PARTITION BY session_id ORDER BY cue_no) AS e
              FROM (SELECT conv_id AS session_id, turn + 1 AS cue_no, role AS speaker, text,
                           400 * len({tok('text')}) AS dur FROM conversations))""",
    "v_words": f"""
        SELECT session_id, utterance_id, unnest(range(len(w))) AS pos, unnest(w) AS word
        FROM (SELECT conv_id AS session_id, turn AS utterance_id, {tok('text')} AS w FROM conversations)""",
    "v_fragments": f"""
        SELECT session_id, utterance_id, pos // 4 AS frag_no, string_agg(word, ' ' ORDER BY pos) AS text,
               CAST(min(pos) * 400 AS BIGINT) AS start_ms, CAST((max(pos) + 1) * 400 AS BIGINT) AS end_ms
        FROM v_words GROUP BY ALL""",
    "v_session_fragments": """
        SELECT f.session_id, f.utterance_id, CAST(base + frag_no AS BIGINT) AS frag_no, text,
               CAST(start_ms + off AS BIGINT) AS start_ms, CAST(end_ms + off AS BIGINT) AS end_ms
        FROM v_fragments f JOIN (
          SELECT session_id, utterance_id,
                 coalesce(sum(len) OVER w, 0) AS off, coalesce(sum(n) OVER w, 0) AS base
          FROM (SELECT session_id, utterance_id, count(*) AS n,
                       max(end_ms) + CASE WHEN utterance_id % 3 = 2 THEN 1000 ELSE 0 END AS len
                FROM v_fragments GROUP BY session_id, utterance_id)
          WINDOW w AS (PARTITION BY session_id ORDER BY utterance_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ) u ON f.session_id = u.session_id AND f.utterance_id = u.utterance_id""",
    "v_frames": """
        SELECT vec_id % 10 AS session_id, vec_id // 10 AS frame_no, (vec_id // 10) * 100 AS start_ms,
               (vec_id // 10) * 100 + 100 AS end_ms,
               list_transform(embedding, lambda x: CAST(x AS DOUBLE)
                 * (CASE WHEN label >= 7 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) * label END)) AS samples
        FROM embeddings""",
    "v_latency": "SELECT user_id AS session_id, ts, event_id, value AS latency_ms FROM events",
    "v_gpu": """
        SELECT user_id % 4 AS gpu, ts, event_id,
               CASE WHEN event_type <> 'error' THEN least(value, 100.0) END AS util FROM events""",
    "v_sounds": """
        SELECT user_id % 5 AS session_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS window_no,
               CASE event_type WHEN 'click' THEN 'Clapping' WHEN 'purchase' THEN 'Applause' WHEN 'view' THEN 'Music'
                    WHEN 'signup' THEN 'Speech' ELSE 'Siren' END AS label,
               max(least(value / 100, 1.0)) AS prob FROM events GROUP BY ALL""",
    "v_pairs": rf"""
        SELECT doc_id, seg_no, lang, source, array_to_string(r[seg_no * 60 + 1:seg_no * 60 + 60], ' ') AS ref,
          coalesce(array_to_string(list_filter(h[seg_no * 60 + 1:seg_no * 60 + 60], lambda x: x IS NOT NULL), ' '), '') AS hyp
        FROM (SELECT *, unnest(range(greatest(1, (len(r) + 59) // 60))) AS seg_no,
            list_transform(r, lambda w, i: CASE WHEN (i - 1) % 11 = 5 THEN NULL WHEN (i - 1) % 13 = 7 THEN 'zz'
              WHEN (i - 1) % 17 = 9 THEN w || ' qq' ELSE w END) AS h
          FROM (SELECT doc_id, lang, source,
                  {tok("regexp_replace(lower(coalesce(text, '')), '[^" + LETTERS + "]', '', 'g')")} AS r FROM documents))""",
    "v_urls": """
        SELECT page_id,
          CASE page_id % 5 WHEN 0 THEN 'https://www.youtube.com/watch?v=id%20' || page_id || '&t=3'
            WHEN 1 THEN 'https://youtu.be/id' || page_id WHEN 2 THEN 'RTMP://host/live/' || page_id
            WHEN 3 THEN 'sdi://' || page_id ELSE url END AS url,
          CASE WHEN page_id % 7 = 0 THEN 'rtmp://out/' || page_id ELSE '' END AS dest FROM pages""",
    "v_archive": """
        SELECT o_custkey AS id, o_orderkey AS seq, epoch_ms(o_orderdate) AS created_at, o_orderstatus AS status
        FROM orders""",
    "v_live": "SELECT c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'",
    "v_devices": """
        SELECT s_suppkey % 7 AS host, s_suppkey AS idx, 'p' || s_suppkey AS persistent_id, s_name AS label,
               s_suppkey % 2 = 0 AS in_vsrc, s_suppkey % 3 = 0 AS in_asrc, s_suppkey % 5 < 3 AS in_vsink FROM supplier""",
    "v_sessions": """
        SELECT c_custkey AS session_id,
               CASE WHEN c_custkey % 3 = 0 THEN 'sdi://' || (c_custkey % 40) ELSE 'http://h/' || c_custkey END AS url,
               CASE c_custkey % 3 WHEN 0 THEN 'sdi' WHEN 1 THEN 'youtube' ELSE 'stream' END AS source_type,
               CASE c_custkey % 4 WHEN 0 THEN 'live' WHEN 1 THEN 'starting' WHEN 2 THEN 'ended' ELSE 'error' END AS status,
               c_custkey * 1000 AS started_ms, c_custkey % 7 AS host FROM customer""",
    "v_polls": """
        SELECT user_id AS session_id, ts, event_id, event_type <> 'error' AS locked FROM events""",
    "v_log": "SELECT event_id AS seq, event_type || ' ' || value AS line FROM events",
}

NEEDS = {"v_fragments": ["v_words"], "v_session_fragments": ["v_words", "v_fragments"]}


def with_views(names: str, body: str, recursive: bool = False, extra: str = "") -> str:
    """Put the named views (and what they need) in front of a query; ``extra`` holds further CTEs."""
    order: list[str] = []
    for name in names.split():
        for n in [*NEEDS.get(name, []), name]:
            if n not in order:
                order.append(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    if extra:
        ctes.append(extra)
    return ("WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n" + body) if ctes else body
