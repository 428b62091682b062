"""DuckDB SQL for the rows of registered queries."""

from __future__ import annotations

import re

from .views import with_views

#: Text of a corner's line, as the query makes it.
LINE = """concat(CASE p_partkey % 4 WHEN 0 THEN 'SR ' WHEN 1 THEN 'the ' WHEN 2 THEN 'DE ' ELSE '' END, CASE p_partkey % 5 WHEN 0 THEN concat('OP', lpad(p_size::VARCHAR, 2, '0'), '-', (p_partkey % 1000)::VARCHAR)
  WHEN 1 THEN concat(p_size::VARCHAR, ' / 198') WHEN 2 THEN concat('LOB-EN', p_size::VARCHAR) WHEN 3 THEN p_name ELSE concat('no ', p_partkey::VARCHAR) END)"""

NUMBER = r"regexp_replace(regexp_replace(upper({0}), '[^A-Z0-9]', '', 'g'), '^0+([0-9])', '\1')"


def number(x: str) -> str:
    return NUMBER.format(x)


def corner(t: str) -> str:
    """What an upper-case text of a corner says, as columns."""
    hyphenated, over = r"\b([A-Z]{2,4}[0-9]{0,2})[-–]([A-Z]{2})?([0-9]{1,4})\b", r"\b([0-9]{1,3})\s*/\s*([0-9]{1,3})\b"

    def found(pattern: str, group: int = 1, text: str = t) -> str:
        return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"

    bare = rf"regexp_replace({t}, '\b(THE|AND|FOR|INC|LTD|ILLUS|NM|EN|US)\b', ' ', 'g')"
    code = f"coalesce({found(hyphenated)}, {found(r'\b([A-Z]{2,5})\b', text=bare)})"
    number = f"coalesce({found(hyphenated, 3)}, {found(over)}, {found(r'\b([0-9]{1,4})\b')})"
    language = rf"coalesce(lower({found(hyphenated, 2)}), CASE WHEN regexp_matches({t}, '\bDE\b') THEN 'de' END)"
    return f"{code} AS set_code, {number} AS number, {found(over, 2)} AS set_total, {language} AS language"


#: Words of four letters and more in a line, within so many edits: every part of about the word's length is tried.
SIMILARITY = """
  words AS (SELECT DISTINCT name, w FROM (SELECT name, unnest(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS w FROM named)),
  per AS (SELECT name, len(list_filter(regexp_split_to_array(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 4)) AS n FROM named),
  lined AS (SELECT key, regexp_replace(lower(line), '[^a-z0-9]', '', 'g') AS line FROM (SELECT key, unnest(lines) AS line FROM read_lines)),
  tried AS (SELECT key, name, w, CASE WHEN length(w) >= 8 THEN 2 WHEN length(w) >= 5 THEN 1 ELSE 0 END AS k, line FROM lined, words),
  hit AS (SELECT key, name, w, max(CASE WHEN contains(line, w) THEN 1 WHEN k = 0 THEN 0
    WHEN len(list_filter(range(1, greatest(length(line), 1) + 1), lambda i: levenshtein(substr(line, i, length(w)), w) <= k OR levenshtein(substr(line, i, length(w) - 1), w) <= k OR levenshtein(substr(line, i, length(w) + 1), w) <= k
      OR (k = 2 AND (levenshtein(substr(line, i, length(w) - 2), w) <= k OR levenshtein(substr(line, i, length(w) + 2), w) <= k)))) > 0 THEN 1 ELSE 0 END) AS found FROM tried GROUP BY ALL),
  alike AS (SELECT key, h.name, sum(found)::DOUBLE / max(n) AS similarity FROM hit h JOIN per p ON p.name = h.name GROUP BY ALL)"""

KNN = """+ asked AS (SELECT row AS query_id, embedding::DOUBLE[] AS q FROM index_rows WHERE row % 50 = 0),
  scored AS (SELECT query_id, row, id, label, list_inner_product(embedding::DOUBLE[], q) AS score FROM index_rows, asked),
  knn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row) AS rank FROM scored QUALIFY rank <= 10)"""
VOTE = KNN + """,
  frames AS (SELECT query_id // 250 AS scan_id, (query_id // 50) % 5 AS frame, rank, id, row, score FROM knn),
  n AS (SELECT scan_id, count(DISTINCT frame) AS frames FROM frames GROUP BY ALL),
  summed AS (SELECT scan_id, id, sum(score::DECIMAL(24, 12))::DOUBLE AS total, min({'f': frame, 'r': rank, 'w': row}) AS seen FROM frames GROUP BY ALL),
  voted AS (SELECT s.scan_id, id, seen.w AS row, total / n.frames AS score, n.frames, row_number() OVER (PARTITION BY s.scan_id ORDER BY total / n.frames DESC, seen.f, seen.r) AS rank FROM summed s JOIN n USING (scan_id) QUALIFY rank <= 10)"""
ARTS = VOTE + """,
  best AS (SELECT v.*, concat('art:', i.label::VARCHAR) AS art_id, row_number() OVER (PARTITION BY scan_id, i.label ORDER BY rank) AS n FROM voted v JOIN index_rows i ON i.id = v.id),
  arts AS (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY rank) AS art_rank, art_id, id, score, frames FROM best WHERE n = 1 QUALIFY art_rank <= 5)"""
TOPS = ARTS + """,
  tops AS (SELECT scan_id, max(art_id) FILTER (art_rank = 1) AS art_id, max(id) FILTER (art_rank = 1) AS id, max(score) FILTER (art_rank = 1) AS top, max(score) FILTER (art_rank = 2) AS second, max(frames) AS frames FROM arts GROUP BY ALL)"""

CANDIDATES = TOPS + """,
  candidates AS (SELECT a.scan_id, a.art_id, i.id, row_number() OVER (PARTITION BY a.scan_id ORDER BY a.art_rank, i.row) AS ordinal FROM arts a JOIN index_rows i ON concat('art:', i.label::VARCHAR) = a.art_id JOIN printings p ON p.id = i.id)"""

#: Masked forms of a serial: itself, and each digit as _ .
MASKS = """SELECT {key}, unnest(list_concat([{serial}], list_transform(list_filter(range(1, length({serial}) + 1), lambda i: regexp_matches(substr({serial}, i, 1), '[0-9]')), lambda i: concat(substr({serial}, 1, i - 1), '_', substr({serial}, i + 1))))) AS pattern"""
NEAR = f"""+ a AS ({MASKS.format(key='scan_id, game_id, serial, seen', serial='serial')} FROM reads),
  b AS ({MASKS.format(key='id, game_id', serial='number')} FROM printings),
  met AS (SELECT DISTINCT scan_id, serial, seen, id FROM a JOIN b USING (game_id, pattern)),
  near AS (SELECT m.scan_id, m.serial, m.seen, p.*, row_number() OVER (PARTITION BY scan_id ORDER BY release_date DESC NULLS LAST, p.id) AS place FROM met m JOIN printings p USING (id) QUALIFY place <= 400)"""
CHOICE = NEAR + """,
  named AS (SELECT DISTINCT name FROM near), read_lines AS (SELECT DISTINCT scan_id AS key, [seen, concat('x ', seen)] AS lines FROM near),""" + SIMILARITY + """,
  evidence AS (SELECT n.*, coalesce(s.similarity, 0) AS name_score, n.number = n.serial AS exact, list_inner_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS image_score
    FROM near n LEFT JOIN alike s ON s.key = n.scan_id AND s.name = n.name LEFT JOIN index_rows i ON i.id = n.id LEFT JOIN index_rows q ON q.row = n.scan_id),
  chosen AS (SELECT scan_id, serial AS read, number AS serial, exact, name_score, image_score FROM evidence
    QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY name_score + 0.4 * exact::INT + 0.6 * coalesce(image_score, 0) DESC, place) = 1)"""
RANKED = CHOICE + """,
  ranked AS (SELECT e.*, c.serial AS chosen, regexp_replace(upper(e.set_code), '[\\s-]', '', 'g') = split_part(c.serial, '-', 1) AS home FROM evidence e JOIN chosen c USING (scan_id) WHERE e.number = c.serial),
  placed AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY coalesce(image_score, -1) + CASE WHEN home THEN 0.05 ELSE 0 END DESC, variant = 'normal' DESC, place) AS spot FROM ranked)"""
GRADED = RANKED + """,
  two AS (SELECT scan_id, count(*) AS n, max(id) FILTER (spot = 1) AS printing_id, max(image_score) FILTER (spot = 1) AS top, max(image_score) FILTER (spot = 2) AS second FROM placed GROUP BY ALL),
  gaps AS (SELECT t.*, c.read, c.serial, c.exact, c.name_score, coalesce(c.image_score, 0) AS looks, CASE WHEN n > 1 AND second IS NOT NULL THEN top - second ELSE 0 END AS gap0 FROM two t JOIN chosen c USING (scan_id)),
  graded AS (SELECT *, CASE WHEN n = 1 THEN 0.95 WHEN gap0 >= 0.03 THEN 0.9 ELSE 0.7 END AS base, CASE WHEN NOT exact THEN name_score < 0.7 ELSE name_score < 0.5 AND looks < 0.6 END AS doubtful FROM gaps)"""

QUADS = """+ made AS (SELECT event_id, user_id::VARCHAR AS camera_id, ts, value, event_id % 17 <> 0 AS present, (event_id % 10) / 20.0::DOUBLE AS s, (event_id % 7) / 100.0::DOUBLE AS d, CASE WHEN event_id % 11 = 0 THEN 0.05 ELSE 0.5 END::DOUBLE AS side, event_id % 13 = 0 AS odd FROM events),
  q AS (SELECT *, s AS x0, d AS y0, s + side AS x1, d AS y1, s + side * CASE WHEN odd THEN 0.1 ELSE 1 END AS x2, d + side * CASE WHEN odd THEN 0.2 ELSE 1 END AS y2, s AS x3, d + side AS y3 FROM made),
  area AS (SELECT *, abs(x0*y1 - x1*y0 + x1*y2 - x2*y1 + x2*y3 - x3*y2 + x3*y0 - x0*y3) / 2 AS area,
    [(x0 - x3) * (y1 - y0) - (y0 - y3) * (x1 - x0), (x1 - x0) * (y2 - y1) - (y1 - y0) * (x2 - x1), (x2 - x1) * (y3 - y2) - (y2 - y1) * (x3 - x2), (x3 - x2) * (y0 - y3) - (y3 - y2) * (x0 - x3)] AS turns,
    least((x0-x1)**2 + (y0-y1)**2, (x0-x2)**2 + (y0-y2)**2, (x0-x3)**2 + (y0-y3)**2, (x1-x2)**2 + (y1-y2)**2, (x1-x3)**2 + (y1-y3)**2, (x2-x3)**2 + (y2-y3)**2) AS nearest FROM q),
  graded AS (SELECT *, area >= 0.01 AND nearest >= 0.0004 AND NOT (list_max(turns) > 0 AND list_min(turns) < 0) AS usable FROM area)"""
GATE = QUADS + """,
  runs AS (SELECT *, event_id AS seq, (event_id % 40 + 1)::DOUBLE AS sharpness, sum((NOT present)::INT) OVER (PARTITION BY camera_id ORDER BY ts, event_id) AS run FROM q),
  lagged AS (SELECT *, lag(present, 2) OVER w AND true AS three, lag(x0, 2) OVER w AS fx0, lag(y0, 2) OVER w AS fy0, lag(x1, 2) OVER w AS fx1, lag(y1, 2) OVER w AS fy1, lag(x2, 2) OVER w AS fx2, lag(y2, 2) OVER w AS fy2, lag(x3, 2) OVER w AS fx3, lag(y3, 2) OVER w AS fy3,
    lag(x0) OVER w AS gx0, lag(y0) OVER w AS gy0, lag(x1) OVER w AS gx1, lag(y1) OVER w AS gy1, lag(x2) OVER w AS gx2, lag(y2) OVER w AS gy2, lag(x3) OVER w AS gx3, lag(y3) OVER w AS gy3 FROM runs WINDOW w AS (PARTITION BY camera_id, run ORDER BY ts, event_id)),
  drift AS (SELECT *, greatest(sqrt((x0-fx0)**2+(y0-fy0)**2), sqrt((x1-fx1)**2+(y1-fy1)**2), sqrt((x2-fx2)**2+(y2-fy2)**2), sqrt((x3-fx3)**2+(y3-fy3)**2), sqrt((gx0-fx0)**2+(gy0-fy0)**2), sqrt((gx1-fx1)**2+(gy1-fy1)**2), sqrt((gx2-fx2)**2+(gy2-fy2)**2), sqrt((gx3-fx3)**2+(gy3-fy3)**2)) AS far FROM lagged),
  gated AS (SELECT camera_id, seq, ts, CASE WHEN NOT present THEN 'no-card' WHEN sharpness < 12 THEN 'blurry' WHEN three IS NULL OR NOT three THEN 'steadying' WHEN far > {drift} THEN 'moving' END AS reason FROM drift)"""

ENTRIES = "+ entries AS (SELECT o_custkey AS portfolio_id, l_partkey::VARCHAR AS printing_id, l_returnflag AS variant, l_linestatus AS condition, l_quantity::BIGINT AS quantity, l_extendedprice AS cost_basis, o_orderdate AS added_at, {'a': l_orderkey, 'b': l_linenumber, 'c': l_suppkey, 'd': l_shipdate, 'e': l_quantity, 'f': l_extendedprice} AS seq FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
PACKS = "+ p AS (SELECT * REPLACE (concat(game_id, ':', name) AS card_id), TIMESTAMP '1996-01-01' + to_days((ordinal % 2000)::INT) AS updated_at FROM printings), c AS (SELECT DISTINCT card_id, game_id, name, art_id FROM p), g AS (SELECT unnest(['0', '1', '2', '3', '4']) AS game)"
CHANGED = "updated_at > TIMESTAMP '2000-01-01'"
PACKED = {
    "sets": 'SELECT set_id::VARCHAR AS id, game_id AS "gameId", set_code AS code, set_name AS name, release_date AS "releaseDate", game_id AS game FROM sets',
    "cards": 'SELECT card_id AS id, game_id AS "gameId", name, art_id AS "artId", game_id AS game FROM c',
    "printings": """SELECT id, card_id AS "cardId", game_id AS "gameId", set_id AS "setId", number, set_total AS "setTotal", rarity, variant, language, image_url AS "imageUrl", updated_at::DATE AS "updatedAt", game_id AS game FROM p""",
    "prices": 'SELECT printing_id AS "printingId", source, x.market, x.low, as_of::DATE AS "asOf", game_id AS game FROM prices x JOIN p ON p.id = x.printing_id',
}
STEPS = "steps AS (SELECT game_id AS game, lag(version) OVER w AS source, version AS next, row_number() OVER w AS ordinal FROM versions WINDOW w AS (PARTITION BY game_id ORDER BY created_at, version))"

#: The automatic shutter's state machine, a camera's samples one by one: each row is its state after a sample.
AUTOSCAN = """RECURSIVE thumbs AS (SELECT user_id::VARCHAR AS camera_id, event_id AS seq, epoch_ms(ts) AS ms, list_transform([1, 2, 3, 4], lambda i: ((event_id // 150 // 8) * 37 * i % 200 + value % 2)::DOUBLE) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  walk AS (
    SELECT camera_id, n, seq, ms AS sampled, t AS prev, NULL::DOUBLE[] AS ref, 0 AS stable, 1 AS away, true AS armed, NULL::BIGINT AS kept_at, NULL::DOUBLE[] AS kept, false AS trigger, false AS keep FROM thumbs WHERE n = 1
    UNION ALL
    SELECT camera_id, n, seq, CASE WHEN taken THEN ms ELSE sampled END, CASE WHEN taken THEN t ELSE prev END, CASE WHEN fires THEN t ELSE ref END, CASE WHEN fires THEN 0 ELSE stable END, CASE WHEN fires THEN 0 ELSE away END, armed AND NOT fires,
      CASE WHEN fires AND NOT again THEN ms ELSE kept_at END, CASE WHEN fires AND NOT again THEN t ELSE kept END, fires, fires AND NOT again
    FROM (SELECT *, taken AND armed AND stable >= 5 AS fires, coalesce(ms - kept_at < 30000 AND list_avg(list_transform([1, 2, 3, 4], lambda i: abs((t[i] - list_avg(t)) - (kept[i] - list_avg(kept))))) < 10, false) AS again
    FROM (SELECT * REPLACE (armed OR (taken AND away >= 3) AS armed)
    FROM (SELECT * REPLACE (CASE WHEN NOT taken THEN stable WHEN list_avg(list_transform([1, 2, 3, 4], lambda i: abs(t[i] - prev[i]))) <= 4 THEN stable + 1 ELSE 0 END AS stable,
      CASE WHEN NOT taken THEN away WHEN ref IS NULL OR list_avg(list_transform([1, 2, 3, 4], lambda i: abs((t[i] - list_avg(t)) - (ref[i] - list_avg(ref))))) >= 10 THEN away + 1 ELSE 0 END AS away)
    FROM (SELECT w.camera_id, s.n, s.seq, s.ms, s.t, w.sampled, w.prev, w.ref, w.stable, w.away, w.armed, w.kept_at, w.kept, s.ms - w.sampled >= 120 AS taken FROM walk w JOIN thumbs s ON s.camera_id = w.camera_id AND s.n = w.n + 1)))))
  SELECT camera_id, seq, keep AS kept FROM walk WHERE trigger"""

#: Query name: (views that it reads, SQL). A leading + goes on with the list of common table expressions.
#: The first and the third version of the catalogue, all tables in one form.
RELEASED = """+ p0 AS (SELECT *, number AS shown FROM printings WHERE ordinal % 3 <> 0), p2 AS (SELECT *, CASE WHEN ordinal % 5 = 0 THEN concat(number, '*') ELSE number END AS shown FROM printings WHERE ordinal % 11 <> 0),
  s0 AS (SELECT *, set_name AS shown FROM sets WHERE set_id % 7 <> 6), s2 AS (SELECT *, CASE WHEN set_id % 6 = 5 THEN concat(set_name, '*') ELSE set_name END AS shown FROM sets),
  x0 AS (SELECT printing_id, source, max(market) AS market, min(low) AS low FROM prices GROUP BY ALL), x2 AS (SELECT printing_id, source, CASE WHEN source::INT % 3 = 0 THEN market * 2 ELSE market END AS market, low FROM x0),
  """ + ",".join(f"""
  l{n} AS (SELECT 'sets' AS tbl, game_id AS game, set_id::VARCHAR AS key, concat_ws('|', set_code, shown) AS text, NULL::DOUBLE AS market, NULL::DOUBLE AS low FROM s{n}
    UNION ALL SELECT DISTINCT 'cards', game_id, concat_ws(':', game_id, name), concat_ws('|', name, art_id), NULL, NULL FROM printings
    UNION ALL SELECT 'printings', game_id, id, concat_ws('|', concat_ws(':', game_id, name), set_id::VARCHAR, shown, rarity, variant), NULL, NULL FROM p{n}
    UNION ALL SELECT 'prices', game_id, concat_ws('|', printing_id, source), NULL, x{n}.market::DOUBLE, x{n}.low::DOUBLE FROM x{n} JOIN p{n} ON id = printing_id)""" for n in (0, 2))

SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "knn_topk": (("index_rows",), KNN + " SELECT query_id, rank, row, id, round(score, 6) AS score FROM knn"),
    "knn_topk_in_order": (("index_rows",), KNN + " SELECT query_id, rank, row, id, round(score, 6) AS score FROM knn"),
    "vote_frames": (("index_rows",), VOTE + " SELECT scan_id, rank, id, row, round(score, 6) AS score, frames FROM voted"),
    "expand_arts": (("index_rows",), ARTS + " SELECT scan_id, art_rank, art_id, id, round(score, 6) AS score FROM arts"),
    "picture_confidence": (
        ("index_rows",),
        TOPS
        + """, raw AS (SELECT *, CASE WHEN second IS NULL THEN top ELSE top - second END AS gap FROM tops),
        rated AS (SELECT *, greatest(0, least(1, 0.6 * top + 0.25 * least(1, gap * 8) + CASE scan_id % 3 WHEN 0 THEN 0.1 WHEN 1 THEN -0.15 ELSE 0 END + CASE WHEN frames >= 3 THEN 0.05 ELSE 0 END)) AS s FROM raw)
        SELECT scan_id, art_id, id, CASE WHEN top < 0.5 THEN 'low' WHEN s >= 0.78 THEN 'high' WHEN s >= 0.6 THEN 'check' ELSE 'low' END AS tier, round(s, 6) AS score, round(gap, 6) AS gap,
        concat_ws('; ', CASE scan_id % 3 WHEN 0 THEN 'set/number matched' WHEN 1 THEN 'set/number disagreed' END, CASE WHEN frames >= 3 THEN concat(frames::VARCHAR, ' frames agreed') END, CASE WHEN top < 0.5 THEN 'weak match' END) AS reasons FROM rated""",
    ),
    "best_rotation": (
        ("index_rows",),
        KNN
        + """, turned AS (SELECT query_id // 200 AS frame_id, (query_id // 50) % 4 AS turn, rank, id, score FROM knn WHERE rank > 1),
        tops AS (SELECT frame_id, turn, max(score) AS top FROM turned GROUP BY ALL),
        pick AS (SELECT frame_id, turn FROM tops QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY turn = 0 AND top >= 0.6 DESC, top DESC, turn) = 1)
        SELECT frame_id, turn::INT AS turn, rank, id, round(score, 6) AS score FROM turned JOIN pick USING (frame_id, turn)""",
    ),
    "printing_lookup": (("printings",), "SELECT art_id, row_number() OVER (PARTITION BY art_id ORDER BY release_date DESC NULLS LAST, number, id) AS place, id, name, set_code, number, variant FROM printings"),
    "for_art": (("printings",), "SELECT id, set_code, number, variant, release_date FROM printings WHERE art_id = 'art:blue bolt'"),
    "by_serial": (("printings",), "SELECT id, set_code, number, release_date FROM printings WHERE game_id = '1' AND number = 'OP11-000'"),
    "printing_rows": (
        ("printings", "sets"),
        PACKS
        + """ SELECT p.id, p.card_id, p.game_id, c.name, p.set_id, s.set_code, s.set_name, p.number, p.set_total, p.rarity, p.variant, p.language, p.image_url, c.art_id, s.release_date
        FROM p JOIN c ON c.card_id = p.card_id JOIN sets s ON s.set_id = p.set_id""",
    ),
    "matched_first": (
        ("printings",),
        "SELECT w.s_suppkey::VARCHAR AS wanted, row_number() OVER (PARTITION BY w.s_suppkey ORDER BY p.id = m.id DESC, p.release_date DESC NULLS LAST, p.number, p.id) AS place, p.id, p.art_id FROM supplier w JOIN printings m ON m.id = w.s_suppkey::VARCHAR JOIN printings p ON p.art_id = m.art_id",
    ),
    "name_search": (("printings",), "SELECT id, name, set_code, number FROM printings WHERE name ILIKE '%RING%' ORDER BY name, id LIMIT 50"),
    "names_search": (
        ("printings",),
        """+ q AS (SELECT DISTINCT unnest([substr(name, 2, 1), substr(name, 2, 2), substr(name, 2, 3), substr(name, 2, 4), concat(substr(name, 1, 1), '_', substr(name, 3, 2)), '%', 'no such name']) AS query_id FROM printings)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY name, id) AS place, id, name, number FROM printings, q WHERE name ILIKE concat('%', query_id, '%') QUALIFY place <= 50""",
    ),
    "prices_for": (("prices",), "SELECT printing_id, source, 'EUR' AS currency, market, low, as_of::DATE AS as_of, l_orderkey, l_linenumber FROM prices WHERE printing_id IN (SELECT s_suppkey::VARCHAR FROM supplier)"),
    "serial_near": (("printings", "reads"), NEAR + " SELECT scan_id, serial, id, number, place AS ordinal FROM near"),
    "serial_choose": (("printings", "reads", "index_rows"), CHOICE + " SELECT scan_id, read, serial, exact, round(name_score, 6) AS name_score, round(image_score, 6) AS image_score FROM chosen"),
    "serial_rank": (("printings", "reads", "index_rows"), RANKED + " SELECT scan_id, spot AS place, id, number, home, round(image_score, 6) AS image_score FROM placed"),
    "serial_confidence": (
        ("printings", "reads", "index_rows"),
        GRADED
        + """ SELECT scan_id, printing_id, serial, n, CASE WHEN doubtful THEN 'check' WHEN n = 1 OR gap0 >= 0.03 THEN 'high' ELSE 'check' END AS tier, round(CASE WHEN doubtful THEN least(base, 0.7) ELSE base END, 6)::DOUBLE AS score,
        round(CASE WHEN n = 1 THEN coalesce(top, 0) ELSE gap0 END, 6) AS gap, concat_ws('; ', concat('serial ', serial, ' read from the card'), CASE WHEN n = 1 THEN 'only one printing has it' ELSE concat(n::VARCHAR, ' printings share it') END,
        CASE WHEN n > 1 THEN CASE WHEN gap0 >= 0.03 THEN 'artwork picks one' ELSE 'printings look alike — check which' END END,
        CASE WHEN NOT exact THEN concat('read as ', read, ', but the card name matches ', serial) WHEN name_score >= 0.5 THEN 'card name agrees' WHEN looks >= 0.6 THEN 'picture agrees' ELSE 'serial not yet confirmed by the name or picture' END) AS reasons FROM graded""",
    ),
    "scan_finish": (
        ("printings", "reads", "index_rows"),
        GRADED
        + ","
        + TOPS[1:]
        + """, firsts AS (SELECT a.scan_id, arg_min(i.id, i.row) AS id FROM arts a JOIN index_rows i ON concat('art:', i.label::VARCHAR) = a.art_id WHERE a.art_rank = 1 GROUP BY ALL),
        rated AS (SELECT t.scan_id, f.id, top, greatest(0, least(1, 0.6 * top + 0.25 * least(1, CASE WHEN second IS NULL THEN top ELSE top - second END * 8) + CASE WHEN frames >= 3 THEN 0.05 ELSE 0 END)) AS s FROM tops t JOIN firsts f USING (scan_id))
        SELECT scan_id, printing_id, 'serial' AS "by", CASE WHEN doubtful THEN 'check' WHEN n = 1 OR gap0 >= 0.03 THEN 'high' ELSE 'check' END AS tier, round(CASE WHEN doubtful THEN least(base, 0.7) ELSE base END, 6)::DOUBLE AS score FROM graded
        UNION ALL SELECT scan_id, id, 'picture', CASE WHEN top < 0.5 THEN 'low' WHEN s >= 0.78 THEN 'high' WHEN s >= 0.6 THEN 'check' ELSE 'low' END, round(s, 6) FROM rated WHERE scan_id NOT IN (SELECT scan_id FROM graded)""",
    ),
    "name_similarity": (("cards",), "+ named AS (SELECT name FROM cards), read_lines AS (SELECT item_id AS key, string_split(text, chr(10)) AS lines FROM benchmark)," + SIMILARITY + " SELECT key AS item_id, name, round(similarity, 6) AS similarity FROM alike WHERE similarity > 0"),
    "picture_with_corner": (
        ("index_rows", "printings"),
        CANDIDATES
        + """, read AS (SELECT ordinal // 10 AS scan_id, set_total FROM printings WHERE ordinal % 10 = 0),
        many AS (SELECT c.scan_id, count(*) FILTER (c.art_id = t.art_id) AS n, arg_min(c.id, c.ordinal) AS first_id FROM candidates c JOIN tops t USING (scan_id) GROUP BY ALL),
        hits AS (SELECT c.scan_id, c.id, c.ordinal, 0.4 * (ltrim(p.number, '0') = r.set_total)::INT + 0.2 * (p.set_total = r.set_total)::INT AS score FROM candidates c JOIN read r USING (scan_id) JOIN printings p ON p.id = c.id),
        picked AS (SELECT scan_id, id FROM hits WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY score DESC, ordinal) = 1),
        rated AS (SELECT t.*, CASE WHEN many.n > 1 THEN b.id END AS read_id, many.first_id, CASE WHEN second IS NULL THEN top ELSE top - second END AS gap FROM tops t LEFT JOIN many USING (scan_id) LEFT JOIN picked b USING (scan_id)),
        marked AS (SELECT *, greatest(0, least(1, 0.6 * top + 0.25 * least(1, gap * 8) + CASE WHEN read_id IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN frames >= 3 THEN 0.05 ELSE 0 END)) AS s FROM rated)
        SELECT scan_id, coalesce(read_id, first_id) AS printing_id, CASE WHEN top < 0.5 THEN 'low' WHEN s >= 0.78 THEN 'high' WHEN s >= 0.6 THEN 'check' ELSE 'low' END AS tier, round(s, 6) AS score,
        concat_ws('; ', CASE WHEN read_id IS NOT NULL THEN 'set/number matched' END, CASE WHEN frames >= 3 THEN concat(frames::VARCHAR, ' frames agreed') END, CASE WHEN top < 0.5 THEN 'weak match' END) AS reasons FROM marked""",
    ),
    "alternatives": (
        ("index_rows", "printings"),
        CANDIDATES + ", firsts AS (SELECT scan_id, arg_min(id, ordinal) AS id FROM candidates GROUP BY ALL) SELECT c.scan_id, row_number() OVER (PARTITION BY c.scan_id ORDER BY ordinal) AS place, c.id FROM candidates c JOIN firsts f ON f.scan_id = c.scan_id AND f.id <> c.id QUALIFY place <= 10",
    ),
    "other_candidates": (("index_rows", "printings"), CANDIDATES + " SELECT scan_id, art_rank, art_id FROM arts WHERE (scan_id, art_id) NOT IN (SELECT (scan_id, art_id) FROM candidates WHERE id::BIGINT % 40 = 1)"),
    "first_reading": (
        (),
        """SELECT l_orderkey AS frame_id, concat('OP', lpad((s % 100)::VARCHAR, 2, '0'), '-', lpad((s % 1000)::VARCHAR, 3, '0')) AS serial, (l_linenumber - 1)::INT AS turn FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS s FROM lineitem WHERE l_linenumber <= 4 GROUP BY ALL)
        WHERE s % 3 = 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1""",
    ),
    "corner_parse": ((), f"SELECT p_partkey, {corner('t')} FROM (SELECT p_partkey, upper(concat({LINE}, ' ©2024')) AS t FROM part)"),
    "serial_parse": (
        (),
        """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN concat('OP', lpad(p_size::VARCHAR, 2, '0'), '-0', lpad(p_size::VARCHAR, 2, '0')) WHEN 1 THEN concat('ST', substr(n, 1, 2), '-', substr(n, 3, 3)) WHEN 2 THEN concat('P-', lpad(p_size::VARCHAR, 3, '0'))
        WHEN 4 THEN concat('EB', lpad(p_size::VARCHAR, 2, '0'), '-51', (p_partkey % 10)::VARCHAR) END AS serial FROM (SELECT *, lpad((p_partkey % 100000)::VARCHAR, 5, '0') AS n FROM part)""",
    ),
    "near_patterns": (("printings",), "SELECT id, unnest(range(len(l)))::INT AS place, unnest(l) AS pattern FROM (SELECT id, list_concat([number], list_transform(list_filter(range(1, length(number) + 1), lambda i: regexp_matches(substr(number, i, 1), '[0-9]')), lambda i: concat(substr(number, 1, i - 1), '_', substr(number, i + 1)))) AS l FROM printings)"),
    "rank_printings": (
        ("printings",),
        f"""+ lines AS (SELECT p_name, upper(arg_min({LINE}, p_partkey)) AS t FROM part GROUP BY ALL), read AS (SELECT p_name, {corner('t')} FROM lines),
        hits AS (SELECT p.*, coalesce(upper(p.set_code) = r.set_code, false) AS a, coalesce({NUMBER.format('r.number')} = {NUMBER.format('p.number')}, false) AS b, coalesce({NUMBER.format('r.set_total')} = {NUMBER.format('p.set_total')}, false) AS c, coalesce(p.language = r.language, false) AS d
          FROM printings p JOIN read r ON r.p_name = p.name WHERE r.set_code IS NOT NULL OR r.number IS NOT NULL OR r.set_total IS NOT NULL),
        scored AS (SELECT *, 0.5 * a::INT + 0.4 * b::INT + 0.2 * c::INT + 0.1 * d::INT AS s FROM hits)
        SELECT art_id AS scan_id, row_number() OVER (PARTITION BY art_id ORDER BY s DESC, ordinal) AS place, id, round(s, 6)::DOUBLE AS score, concat_ws(',', CASE WHEN a THEN 'set' END, CASE WHEN b THEN 'number' END, CASE WHEN c THEN 'setTotal' END, CASE WHEN d THEN 'language' END) AS matched_on FROM scored WHERE s > 0""",
    ),
    "normalise_keys": (
        ("printings",),
        f"""SELECT id, concat_ws(':', game_id, regexp_replace(upper(set_code), '[^A-Z0-9]', '', 'g'), {number('number')}, variant, 'en') AS printing_key, concat_ws(':', game_id, regexp_replace(upper(set_code), '[^A-Z0-9]', '', 'g')) AS set_key,
        concat(name, ' emigre') AS name_key, concat_ws('|', regexp_replace(upper(set_code), '[^A-Z0-9]', '', 'g'), {number("lpad(id, 8, '0')")}, concat(name, ' emigre')) AS match_key FROM printings""",
    ),
    "variant_rules": ((), "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'reverse' WHEN 1 THEN 'first_edition' WHEN 2 THEN 'foil' WHEN 3 THEN 'foil' ELSE 'normal' END AS variant FROM part"),
    "split_number": ((), "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lpad(p_size::VARCHAR, 3, '0') WHEN 1 THEN concat('OP07-', p_size::VARCHAR) ELSE concat('TG', p_size::VARCHAR) END AS number, CASE p_partkey % 3 WHEN 0 THEN '198' WHEN 2 THEN 'TG30' END AS total FROM part"),
    "numbers_match": ((), f"SELECT p_partkey, coalesce({number('a')} = {number('b')}, false) AS matches FROM (SELECT p_partkey, lpad(p_size::VARCHAR, 3, '0') AS a, CASE p_partkey % 3 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN concat('0-', p_size::VARCHAR) END AS b FROM part)"),
    "money_parse": ((), "SELECT event_id, CASE event_id % 6 WHEN 0 THEN value::DECIMAL(18, 2)::DOUBLE WHEN 1 THEN trunc(value)::DOUBLE ELSE 7.0::DOUBLE END AS market FROM events WHERE event_id % 6 IN (0, 1, 5)"),
    "extended_json": ((), "SELECT event_id, props->>'$.k' AS number, 'R' AS rarity, NULL::VARCHAR AS missing FROM events"),
    "url_version": (
        (),
        """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url ELSE concat(url, CASE WHEN contains(url, '?') THEN '&' ELSE '?' END, 'e=%22v%20', page_id::VARCHAR, '%2F%C3%A9~%22') END AS address,
        concat(regexp_replace(url, '/$', ''), '/packs/games/', page_id::VARCHAR, '/index-20240101.bin') AS pack, concat('games/', page_id::VARCHAR, '/index-20240101.ids') AS ids, page_id % 4 <> 0 AS stale FROM pages""",
    ),
    "price_labels": (
        (),
        """SELECT CASE WHEN l_linenumber % 7 = 0 THEN '—' ELSE concat(sign, printf('%.2f', l_quantity)) END AS label, sign, count(*) AS n FROM (SELECT *, CASE l_linenumber % 4 WHEN 0 THEN '£' WHEN 1 THEN '€' ELSE '$' END AS sign FROM lineitem) GROUP BY ALL""",
    ),
    "l2_normalise": (
        (),
        """SELECT vec_id, round(CASE WHEN norm = 0 THEN 0 ELSE list_inner_product(v, v) / norm / norm END, 6) AS squared, round(CASE WHEN norm = 0 THEN v[1] ELSE v[1] / norm END, 6) + 0.0::DOUBLE AS first
        FROM (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS norm FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * (vec_id % 3)) AS v FROM embeddings))""",
    ),
    "quad_filter": ((), QUADS + " SELECT event_id, round(area, 6) AS area, usable, CASE WHEN NOT present THEN 'no-card' WHEN NOT usable THEN 'bad-quad' WHEN area < 0.1 THEN 'too-small' END AS rejected FROM graded"),
    "ordered_corners": ((), QUADS + " SELECT event_id, round(x0, 6) AS x0, round(y0, 6) AS y0, round(x1, 6) AS x1, round(y1, 6) AS y1, round(x2, 6) AS x2, round(y2, 6) AS y2, round(x3, 6) AS x3, round(y3, 6) AS y3 FROM q WHERE NOT odd"),
    "homography": ((), QUADS + " SELECT event_id, round(s + side / 2, 6) AS x, round(d + side / 2, 6) AS y FROM q WHERE NOT odd"),
    "detector_decode": (
        ("detections",),
        """+ raw AS (SELECT event_id, width, height, CASE WHEN event_id % 3 = 0 THEN (event_id % 9) / 100.0 ELSE 1 / (1 + exp(-value)) END AS confidence, event_id % 3 = 0 AS sharp,
          list_transform([[c0, c1], [c2, c3], [c4, c5], [c6, c7]], lambda p: [greatest(0.0, least(1.0, p[1])), greatest(0.0, least(1.0, p[2]))]) AS q FROM detections),
        middle AS (SELECT *, (q[1][1] + q[2][1] + q[3][1] + q[4][1]) / 4 AS cx, (q[1][2] + q[2][2] + q[3][2] + q[4][2]) / 4 AS cy FROM raw),
        flat AS (SELECT event_id, unnest(q) AS p, unnest([1, 2, 3, 4]) AS i, cx, cy FROM middle),
        sorted AS (SELECT event_id, list(p ORDER BY atan2(p[2] - cy, p[1] - cx), i) AS s FROM flat GROUP BY ALL),
        least_sum AS (SELECT *, list_position(list_transform(s, lambda p: p[1] + p[2]), list_min(list_transform(s, lambda p: p[1] + p[2]))) AS f FROM sorted),
        started AS (SELECT event_id, list_concat(s[f:], s[:f - 1]) AS s FROM least_sum),
        edges AS (SELECT r.event_id, confidence, sharp, s, list_transform([1, 2, 3, 4], lambda i: ((s[i][1] - s[i % 4 + 1][1]) * width) ** 2 + ((s[i][2] - s[i % 4 + 1][2]) * height) ** 2) AS e FROM started JOIN raw r USING (event_id)),
        turned AS (SELECT *, list_position(e, list_min(e)) AS f FROM edges),
        o AS (SELECT event_id, confidence, sharp, list_concat(s[f:], s[:f - 1]) AS s FROM turned)
        SELECT event_id, round(confidence, 6)::DOUBLE AS confidence, confidence >= CASE WHEN sharp THEN 0.03 ELSE 0.35 END AS card_present, """
        + ", ".join(f"round(s[{i + 1}][{j + 1}], 6) AS {c}{i}" for i in range(4) for j, c in enumerate("xy"))
        + " FROM o",
    ),
    "capture_gate_frames": ((), GATE.replace("{drift}", "0.04") + " SELECT camera_id, seq, reason FROM gated"),
    "locked_scans": ((), GATE.replace("{drift}", "0.6") + ", locked AS (SELECT *, (row_number() OVER (PARTITION BY camera_id ORDER BY ts, seq) - 1) // 3 AS scan FROM gated WHERE reason IS NULL) SELECT camera_id, seq, scan FROM locked QUALIFY count(*) OVER (PARTITION BY camera_id, scan) = 3"),
    "upsert_prices_lww": (
        ("prices",),
        """+ old AS (SELECT printing_id, source, 'EUR' AS currency, max(market) AS market, max(low) AS low, max(as_of) AS as_of FROM prices WHERE l_orderkey % 2 = 0 GROUP BY ALL),
        new AS (SELECT printing_id, source, CASE WHEN l_linenumber <> 3 THEN market END AS market, low, as_of FROM prices WHERE l_orderkey % 2 = 1 QUALIFY row_number() OVER (PARTITION BY printing_id, source ORDER BY as_of DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, prices.market DESC, low DESC) = 1)
        SELECT coalesce(n.printing_id, o.printing_id) AS printing_id, coalesce(n.source, o.source) AS source, coalesce(o.currency, 'USD') AS currency, CASE WHEN n.source IS NULL THEN o.market ELSE n.market END AS market, CASE WHEN n.source IS NULL THEN o.low ELSE n.low END AS low,
        (CASE WHEN n.source IS NULL THEN o.as_of ELSE n.as_of END)::DATE AS as_of FROM old o FULL JOIN new n ON n.printing_id = o.printing_id AND n.source = o.source""",
    ),
    "upsert_cards_first_last": (("printings",), "SELECT card_id AS id, concat(max(name), ' ', arg_max(id, ordinal)) AS name, concat(max(art_id), ':', arg_min(id, ordinal)) AS art_id FROM printings GROUP BY card_id"),
    "upsert_additive": ((), ENTRIES + " SELECT portfolio_id, printing_id, variant, condition, sum(quantity)::BIGINT AS quantity, arg_min(cost_basis, seq) AS cost_basis FROM entries GROUP BY ALL"),
    "delta_apply_delete": (
        ("printings",),
        "SELECT id, CASE WHEN ordinal % 2 = 0 THEN card_id ELSE 'other' END AS card_id, set_id, CASE WHEN ordinal % 3 = 0 THEN concat(number, 'x') ELSE number END AS number, rarity, variant FROM printings WHERE (ordinal % 2 = 0 OR ordinal % 3 = 0) AND ordinal % 5 <> 0",
    ),
    "fingerprints_done": (("printings", "index_rows"), "SELECT p.id, CASE WHEN i.id IS NOT NULL THEN 2 ELSE fingerprinted_at END AS fingerprinted_at FROM printings p LEFT JOIN index_rows i USING (id)"),
    "insert_missing": (("printings",), "SELECT id, CASE WHEN ordinal % 2 = 0 THEN name ELSE upper(name) END AS name FROM printings"),
    "touched_files": (
        ("printings", "prices"),
        """+ b AS (SELECT printing_id, source, market FROM prices QUALIFY row_number() OVER (PARTITION BY printing_id, source ORDER BY as_of DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC, prices.market DESC, low DESC) = 1),
        a AS (SELECT printing_id, source, market FROM b WHERE NOT (source = '0' AND printing_id IN (SELECT id FROM printings WHERE set_id % 12 = 5)) UNION ALL SELECT id, '0', 1.5 FROM printings WHERE set_id % 12 = 5),
        n AS (SELECT printing_id AS id, count(*) AS prices, round(arg_max(market, source), 6) AS market FROM a GROUP BY ALL)
        SELECT id, CASE WHEN set_id % 12 = 5 AND id::INT % 2 = 1 THEN upper(name) ELSE name END AS name, CASE WHEN set_id % 12 = 5 THEN concat(number, '*') ELSE number END AS number, prices, market FROM printings LEFT JOIN n USING (id)""",
    ),
    "full_pack_counts": (
        ("printings", "sets", "prices"),
        PACKS
        + """ SELECT game, 'sets' AS tbl, (SELECT count(*) FROM sets WHERE game_id = game) AS n FROM g UNION ALL SELECT game, 'cards', (SELECT count(*) FROM c WHERE game_id = game) FROM g UNION ALL SELECT game, 'printings', (SELECT count(*) FROM p WHERE game_id = game) FROM g
        UNION ALL SELECT game, 'prices', (SELECT count(*) FROM prices x JOIN p ON p.id = x.printing_id WHERE p.game_id = game) FROM g""",
    ),
    "delta_since": (
        ("printings", "sets", "prices"),
        PACKS
        + """ SELECT game, 'sets' AS tbl, 0::BIGINT AS n FROM g UNION ALL SELECT game, 'cards', (SELECT count(*) FROM c WHERE game_id = game AND card_id IN (SELECT card_id FROM p WHERE p.game_id = game AND updated_at > TIMESTAMP '2000-01-01')) FROM g
        UNION ALL SELECT game, 'printings', (SELECT count(*) FROM p WHERE game_id = game AND updated_at > TIMESTAMP '2000-01-01') FROM g UNION ALL SELECT game, 'prices', (SELECT count(*) FROM prices x JOIN p ON p.id = x.printing_id WHERE p.game_id = game AND x.as_of > TIMESTAMP '2000-01-01') FROM g""",
    ),
    **{f"full_pack_{t}": (("printings", "sets", "prices"), f"{PACKS} {sql}") for t, sql in PACKED.items()},
    "delta_cards": (("printings",), f"{PACKS} {PACKED['cards']} WHERE (card_id, game_id) IN (SELECT (card_id, game_id) FROM p WHERE {CHANGED})"),
    "delta_printings": (("printings",), f"{PACKS} {PACKED['printings']} WHERE {CHANGED}"),
    "delta_prices": (("printings", "prices"), f"{PACKS} {PACKED['prices']} WHERE as_of > TIMESTAMP '2000-01-01'"),
    "publish_and_sync": (
        ("printings",),
        """SELECT id, concat('1:', name) AS card_id, set_id::VARCHAR AS set_id, CASE WHEN ordinal % 5 = 0 THEN concat(number, '*') ELSE number END AS number, rarity, variant,
        CASE WHEN ordinal % 5 = 0 THEN DATE '2024-03-01' WHEN ordinal % 3 = 0 THEN DATE '2024-02-01' ELSE DATE '2024-01-01' END AS updated_at FROM printings WHERE game_id = '1'""",
    ),
    "snapshot_changes": (
        ("printings", "sets", "prices"),
        f"""{RELEASED} SELECT coalesce(n.tbl, o.tbl) AS tbl, coalesce(n.game, o.game) AS game, coalesce(n.key, o.key) AS key, n.text, n.market, n.low, CASE WHEN o.tbl IS NULL THEN 'added' WHEN n.tbl IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM l0 o FULL JOIN l2 n ON n.tbl = o.tbl AND n.game = o.game AND n.key = o.key WHERE o.tbl IS NULL OR n.tbl IS NULL OR o.text IS DISTINCT FROM n.text OR o.market IS DISTINCT FROM n.market OR o.low IS DISTINCT FROM n.low""",
    ),
    "sync_all_games": (("printings", "sets", "prices"), f"{RELEASED} SELECT tbl, game, key, text, market, low FROM l2"),
    "manifest_latest": (
        ("versions",),
        """+ o AS (SELECT *, row_number() OVER w AS n, lag(version) OVER w AS newer FROM versions WINDOW w AS (PARTITION BY game_id ORDER BY created_at DESC, version DESC)),
        k AS (SELECT game_id, arg_max(index_pack_key, {'c': created_at, 'v': version}) FILTER (index_pack_key IS NOT NULL) AS latest FROM versions GROUP BY ALL),
        d AS (SELECT game_id, list(concat('https://x.test/packs/games/', game_id, '/delta-', version, '-', newer, '.json') ORDER BY n) AS urls FROM o WHERE n BETWEEN 2 AND 15 GROUP BY ALL)
        SELECT o.game_id AS game, version, printings_count AS "printingsCount", concat('https://x.test/packs/games/', o.game_id, '/catalog-', version, '.json') AS "catalogUrl", concat('https://x.test/packs/', coalesce(index_pack_key, latest)) AS "indexUrl0", regexp_replace(concat('https://x.test/packs/', coalesce(index_pack_key, latest)), '\\.bin$', '.ids') AS "indexIdsUrl0",
        to_json(coalesce(urls, []))::VARCHAR AS deltas, coalesce(index_pack_key, latest) IS NULL AS none FROM o JOIN k USING (game_id) LEFT JOIN d USING (game_id) WHERE n = 1""",
    ),
    "delta_chain": (
        ("versions",),
        """RECURSIVE + """ + STEPS + """, ends AS (SELECT game, arg_min(next, ordinal) AS local, arg_max(next, ordinal) AS target FROM steps GROUP BY ALL),
        links AS (SELECT * FROM steps WHERE source IS NOT NULL AND NOT (game::INT % 3 = 0 AND ordinal = 3)),
        walk AS (SELECT e.game, e.target, 1 AS step, l.source, l.next FROM ends e JOIN links l ON l.game = e.game AND l.source = e.local WHERE e.local <> e.target
          UNION ALL SELECT w.game, w.target, w.step + 1, l.source, l.next FROM walk w JOIN links l ON l.game = w.game AND l.source = w.next WHERE w.next <> w.target AND w.step <= 64)
        SELECT game, step, source AS "from", next AS "to" FROM walk WHERE game IN (SELECT game FROM walk GROUP BY game HAVING arg_max(next, step) = max(target) AND max(step) <= 64)""",
    ),
    "version_upsert": (
        ("versions",),
        "SELECT game_id, strftime(created_at, '%Y%m') AS version, arg_max(printings_count, {'c': created_at, 'v': version::BIGINT}) AS printings_count, arg_min({'k': index_pack_key}, {'c': created_at, 'v': version::BIGINT}).k AS index_pack_key, min(created_at)::DATE AS created_at FROM versions GROUP BY ALL",
    ),
    "progress_steps": ((), "SELECT o_custkey::VARCHAR AS game_id, count(*) AS cursor, 12::BIGINT AS total, count(*) AS sets, sum(floor(o_totalprice))::BIGINT AS printings, 2 * count(*) AS prices, count(*) >= 12 AS done FROM orders GROUP BY ALL"),
    "url_hosts": ((), "SELECT regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL"),
    "stale_games": (("versions",), "SELECT game_id, max(created_at)::DATE AS latest FROM versions GROUP BY game_id HAVING max(created_at) < TIMESTAMP '2001-01-01'"),
    "newest_at_most": ((), "SELECT o_custkey::VARCHAR AS game, max(strftime(o_orderdate, '%Y%m%d')) AS version FROM orders WHERE o_orderkey % 4 <> 0 AND strftime(o_orderdate, '%Y%m%d') <= '20000930' GROUP BY ALL"),
    "pending_page": (("printings",), "SELECT id, game_id, image_url FROM printings WHERE image_url IS NOT NULL AND fingerprinted_at IS NULL AND game_id = '1' ORDER BY id LIMIT 500"),
    "pending_all_page": (("printings",), "SELECT id, game_id, image_url FROM printings WHERE image_url IS NOT NULL ORDER BY id LIMIT 2000 OFFSET 100"),
    "select_missing": (("printings", "index_rows"), "SELECT ordinal, id FROM printings WHERE id NOT IN (SELECT id FROM index_rows)"),
    "append_rows": (
        (),
        """SELECT (row_number() OVER (ORDER BY is_new, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) - 1)::BIGINT AS row, l_partkey AS id, l_quantity + is_new AS value
        FROM (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS is_new FROM lineitem)""",
    ),
    "index_append": (
        ("index_rows",),
        """SELECT (row_number() OVER (ORDER BY is_new, row) - 1)::BIGINT AS row, id, round(list_inner_product(e::DOUBLE[], e::DOUBLE[]), 6) AS squared, round(e[1]::DOUBLE, 6) AS first
        FROM (SELECT row, id, 0 AS is_new, embedding AS e FROM index_rows WHERE row % 7 <> 0 UNION ALL SELECT row, id, 1, list_transform(embedding, lambda x: (x + 1)::FLOAT) FROM index_rows WHERE row % 7 = 0)""",
    ),
    "quarantine": ((), """SELECT concat('{"productId":', p_partkey::VARCHAR, ',"name":"', p_name, CASE WHEN p_type = 'PROMO' THEN ' (Foil)' ELSE '' END, '"}') AS payload, 'no-number' AS reason FROM part WHERE p_size % 5 = 0"""),
    "collection_listing": (
        ("printings",),
        """SELECT l_partkey::VARCHAR AS printing_id, p.name, p.set_code, l_returnflag AS entry_variant, l_quantity::BIGINT AS quantity, o_orderdate::DATE AS added_at,
        CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS market, CASE WHEN p_size % 4 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END END AS currency
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN printings p ON p.ordinal = l_partkey JOIN part ON p_partkey = l_partkey WHERE o_custkey = 7""",
    ),
    "default_portfolio": ((), "SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 1"),
    "collection_value": (
        (),
        ENTRIES
        + """, priced AS (SELECT e.*, CASE WHEN p_size % 4 <> 0 THEN p_retailprice END AS market, CASE WHEN p_size % 4 <> 0 THEN CASE WHEN p_size % 2 = 0 THEN 'EUR' ELSE 'USD' END END AS currency FROM entries e JOIN part ON p_partkey::VARCHAR = printing_id)
        SELECT portfolio_id, sum(quantity)::BIGINT AS quantity, round(sum((coalesce(market, 0) * quantity)::DECIMAL(28, 6))::DOUBLE, 2) AS value, coalesce(arg_max(currency, {'a': added_at, 'p': printing_id}) FILTER (currency IS NOT NULL), 'GBP') AS currency FROM priced GROUP BY ALL""",
    ),
    "import_feed": (
        (),
        """WITH rows AS (SELECT *, substr(p_brand, 7)::INT AS grp, lpad(p_size::VARCHAR, 3, '0') AS number, CASE WHEN p_type = 'PROMO' THEN 'foil' ELSE 'normal' END AS variant FROM part WHERE p_size % 5 <> 0),
        keyed AS (SELECT *, concat_ws(':', 'onepiece', concat('SET', grp::VARCHAR), p_size::VARCHAR, variant, 'en') AS id FROM rows),
        ends AS (SELECT id, min(p_partkey) AS first_key, max(p_partkey) AS last_key FROM keyed GROUP BY ALL)
        SELECT e.id, concat('onepiece:', f.p_name) AS card_id, concat('onepiece:SET', f.grp::VARCHAR) AS set_id, f.number, '050' AS set_total, l.p_type AS rarity, f.variant, l.p_partkey AS tcgplayer_product_id, CASE WHEN l.p_size % 4 <> 0 THEN round(l.p_retailprice, 2) END AS market
        FROM ends e JOIN part l0 ON l0.p_partkey = last_key JOIN keyed l ON l.p_partkey = last_key JOIN keyed f ON f.p_partkey = first_key""",
    ),
    "autoscan_batch": ((), AUTOSCAN),
    "stream_autoscan": ((), AUTOSCAN),
    "ordered_autoscan": ((), AUTOSCAN),
    "pack_roundtrip": (("index_rows",), "SELECT row, id, len(embedding)::INT AS dim, true AS near, CASE WHEN list_inner_product(embedding, embedding) = 0 THEN 0 ELSE 1 END::DOUBLE AS squared FROM index_rows"),
}
CORNERS, PICTURE = SQL["picture_with_corner"][1].split("SELECT scan_id, coalesce(read_id", 1)
SERIAL = re.search(r"SELECT scan_id, printing_id, 'serial'.*?FROM graded", SQL["scan_finish"][1], re.S)[0]
SQL["finish_with_corner"] = (
    ("printings", "reads", "index_rows"),
    f"""{GRADED}, {CORNERS[1:]} {SERIAL} UNION ALL SELECT scan_id, printing_id, 'picture', tier, score FROM (SELECT scan_id, coalesce(read_id{PICTURE}) WHERE scan_id NOT IN (SELECT scan_id FROM graded)""",
)
SQL["import_passes"] = SQL["import_feed"]
SQL["pack_roundtrip_half"] = SQL["pack_commit"] = SQL["pack_roundtrip"]
SQL["manifest_latest"] = (
    ("versions",),
    re.sub(r'SELECT o\.game_id AS game', 'SELECT * EXCLUDE ("indexUrl0", "indexIdsUrl0", none), CASE WHEN NOT none THEN "indexUrl0" END AS "indexUrl", CASE WHEN NOT none THEN "indexIdsUrl0" END AS "indexIdsUrl" FROM (SELECT o.game_id AS game', SQL["manifest_latest"][1]) + ")",
)


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, *views) if views or sql.startswith(("+", "RECURSIVE")) else sql for name, (views, sql) in SQL.items()}
