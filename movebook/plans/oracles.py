"""The same queries in SQL that DuckDB runs."""

from __future__ import annotations

ROWS = """
s AS (
    SELECT o_custkey, o_orderdate, o_orderkey, o_orderstatus, substr(o_orderpriority, 1, 1) AS move FROM orders
), p AS (
    SELECT o_custkey, o_orderdate, CAST(row_number() OVER w AS INTEGER) AS ply, move,
        coalesce(list(move) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS prior,
        last_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final,
        last_value(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final_date,
        count(*) OVER (PARTITION BY o_custkey) AS n_plies
    FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
), allp AS (
    SELECT *, coalesce(array_to_string(prior, '>'), '') AS pstate, coalesce(array_to_string(list_sort(prior), '>'), '') AS mstate FROM p
), q AS (
    SELECT * FROM allp WHERE final = 'F'
)"""
PREFIX = ROWS + ", book AS (SELECT pstate AS state, move, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY ALL)"
MULTI = ROWS + ", book AS (SELECT mstate AS state, move, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY ALL)"
TALLY = "SELECT mstate AS state, move, CAST(count(*) AS BIGINT) AS n FROM q GROUP BY ALL"
PROBES = "probes AS (SELECT unnest(['', '1', '1>2', '1>2>3', '5>5>5>5', '9', '1>1>2>3']) AS state)"
SHARE = "CASE WHEN coalesce(b.total, 0) <= 0 THEN '' WHEN b.n / b.total >= 0.01 THEN CAST(CAST(floor(b.n / b.total * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' ELSE '<1%' END"
TOLD = "told AS (SELECT state, move, n, CAST(sum(n) OVER (PARTITION BY state) AS BIGINT) AS total, max(n) OVER (PARTITION BY state) AS top FROM book)"
HISTORY = (
    MULTI
    + """, t AS (SELECT state, CAST(sum(n) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS choices FROM book GROUP BY state),
h AS (SELECT q.o_custkey, q.ply, q.mstate AS state, q.move, book.n, t.total, t.choices FROM q JOIN book ON book.state = q.mstate AND book.move = q.move JOIN t ON t.state = q.mstate)"""
)
GAMES = (
    ROWS
    + """, g AS (
    SELECT o_custkey AS game, list(move ORDER BY ply) AS moves, CASE WHEN count(*) % 3 = 0 THEN 'draw' WHEN count(*) % 2 = 0 THEN 'black' ELSE 'white' END AS winner
    FROM q GROUP BY o_custkey
)"""
)
DUMPS = """
d AS (
    SELECT CAST(rank AS INTEGER) AS rank, tag, 'lichess_db_standard_rated_' || tag || '.pgn.zst' AS filename
    FROM (VALUES (0, '2013-03'), (1, '2013-02'), (2, '2013-01'), (3, '2012-12')) v(rank, tag)
), f AS (
    SELECT * FROM (VALUES ('lichess_db_standard_rated_2013-02.pgn.zst', 3500000), ('lichess_db_standard_rated_2013-01.pgn.zst', 900), ('extra.pgn', 2048)) v(filename, size)
), m AS (
    SELECT * FROM (VALUES (0, 'lichess_db_standard_rated_2013-01.pgn.zst'), (1, 'lichess_db_standard_rated_2012-12.pgn.zst')) v(seq, filename)
), st AS (
    SELECT d.rank, d.tag, d.filename, CASE WHEN f.size IS NOT NULL THEN 'yes' ELSE '-' END AS downloaded,
        CASE WHEN m.filename IS NOT NULL THEN 'yes' WHEN f.size IS NOT NULL THEN 'pending' ELSE '-' END AS processed, CAST(f.size AS BIGINT) AS size
    FROM d LEFT JOIN f USING (filename) LEFT JOIN m USING (filename)
)"""


def human(x: str) -> str:
    return f"""CASE WHEN {x} < 1024 THEN CAST({x} AS VARCHAR) || 'B' WHEN {x} < 1048576 THEN printf('%.1fK', {x} / 1024.0::DOUBLE)
        WHEN {x} < 1073741824 THEN printf('%.1fM', {x} / 1048576.0::DOUBLE) WHEN {x} < 1099511627776 THEN printf('%.1fG', {x} / 1073741824.0::DOUBLE)
        ELSE printf('%.1fT', {x} / 1099511627776.0::DOUBLE) END"""


#: What the embedded games come to: verdict, plies, ending, winner, canonical move indices.
REPLAYED = """
g AS (SELECT * FROM (VALUES
    ('fool', 'ok', 4, 'mate', 'black', '8,4,17,3'), ('scholar', 'ok', 7, 'mate', 'white', '16,4,19,16,29,17,41'),
    ('stalemate', 'ok', 19, 'stalemate', 'draw', '6,0,28,6,31,7,40,23,28,16,39,4,38,1,36,33,40,9,35'),
    ('resigned', 'unfinished', 2, NULL, NULL, ''), ('empty', 'no moves', 0, NULL, NULL, ''), ('wrong result', 'ok', 4, 'mate', 'black', '8,4,17,3'),
    ('bad san', 'bad san', 0, NULL, NULL, ''), ('atomic', 'variant', 0, NULL, NULL, ''), ('fen', 'fen', 0, NULL, NULL, ''),
    ('comments', 'ok', 4, 'mate', 'black', '8,4,17,3'), ('repetition', 'ok', 8, 'mate', 'black', '7,16,1,20,8,4,17,3')
) v(event, verdict, n_plies, ending, winner, indices))"""

ORACLES = {
    "chess_replay": f"WITH {REPLAYED} SELECT event, verdict, CAST(n_plies AS INTEGER) AS n_plies, ending, winner, indices FROM g",
    "chess_kept_skipped": f"WITH {REPLAYED} SELECT 'embedded' AS source, CAST(count(*) FILTER (verdict = 'ok') AS BIGINT) AS kept, CAST(count(*) FILTER (verdict <> 'ok') AS BIGINT) AS skipped FROM g",
    "chess_book": """WITH g AS (SELECT string_split(m, ',') AS m, k FROM (VALUES ('f2f3,e7e5,g2g4,d8h4', 4), ('e2e4,e7e5,f1c4,b8c6,d1h5,g8f6,h5f7', 1), ('g1f3,g8f6,f3g1,f6g8', 1),
            ('e2e3,a7a5,d1h5,a8a6,h5a5,h7h5,a5c7,a6h6,h2h4,f7f6,c7d7,e8f7,d7b7,d8d3,b7b8,d3h7,b8c8,f7g6,c8e6', 1)) v(m, k)),
            p AS (SELECT m[i] AS uci, array_to_string(m[1:i - 1], ',') AS prior, k FROM g, range(1, 30) t(i) WHERE i <= len(m))
        SELECT uci, CAST(count(DISTINCT prior) AS BIGINT) AS positions, CAST(sum(k) AS BIGINT) AS n FROM p GROUP BY uci""",
    "chess_legal_index": """SELECT CAST(idx AS INTEGER) AS idx, uci, CASE WHEN uci IN ('b1a3', 'b1c3', 'g1f3', 'g1h3') THEN 'N' || substr(uci, 3) ELSE substr(uci, 3) END AS san
        FROM (SELECT i - 1 AS idx, ['b1a3', 'a2a3', 'b2b3', 'b1c3', 'c2c3', 'd2d3', 'e2e3', 'g1f3', 'f2f3', 'g2g3', 'g1h3', 'h2h3', 'a2a4', 'b2b4', 'c2c4', 'd2d4', 'e2e4', 'f2f4', 'g2g4', 'h2h4'][i] AS uci FROM range(1, 21) t(i))""",
    "chess_lookup": """SELECT * FROM (VALUES
        ('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1', NULL, 7::BIGINT, 'f2f3', 'f3', 4::BIGINT), ('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1', NULL, 7, 'e2e4', 'e4', 1),
        ('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1', NULL, 7, 'e2e3', 'e3', 1), ('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1', NULL, 7, 'g1f3', 'Nf3', 1),
        ('8/8/8/8/8/8/8/8 w - - 0 1', 'illegal position', 0, NULL, NULL, NULL), ('not a fen', 'invalid FEN', 0, NULL, NULL, NULL)) v(fen, error, total, uci, san, n)""",
    "chess_identify": """SELECT line, CAST(hit AS BIGINT) AS "at", hit IS NOT NULL AS exact FROM (VALUES
        ('fool', NULL), ('wrong result', NULL), ('comments', NULL), ('repetition', NULL), ('scholar', 1), ('stalemate', 2)) v(line, hit)""",
    "chess_material": "SELECT * FROM (VALUES ('rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR', 0, 0, 0), ('5bnr/4p1pq/4Qpkr/7p/7P/4P3/PPPP1PP1/RNB1KBNR', 0, 10, 10), ('k7/8/8/8/8/8/8/KQQ5', 30, 39, 9)) v(board, white_lost, black_lost, difference)",
    "bookfile_roundtrip": f"WITH {MULTI} SELECT * FROM book",
    "seq_plies": f"WITH {ROWS} SELECT o_custkey, ply, pstate AS state, move FROM allp",
    "seq_events_plies": """
        WITH e AS (
            SELECT user_id, ts, event_id, event_type, coalesce(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM events
        ), p AS (
            SELECT event_type AS move, row_number() OVER w AS ply,
                coalesce(list(event_type) OVER (PARTITION BY user_id, segment ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS prior,
                max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment) AS closed
            FROM e WINDOW w AS (PARTITION BY user_id, segment ORDER BY ts, event_id)
        )
        SELECT coalesce(array_to_string(prior, '>'), '') AS state, move, CAST(count(*) AS BIGINT) AS n FROM p WHERE closed = 1 AND ply <= 4 GROUP BY ALL""",
    "seq_conversations": """
        WITH p AS (
            SELECT role AS move, coalesce(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS prior,
                last_value(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final
            FROM conversations
        )
        SELECT coalesce(array_to_string(prior, '>'), '') AS state, move, CAST(count(*) AS BIGINT) AS n FROM p WHERE final = 'assistant' GROUP BY ALL""",
    "seq_qualify": f"""WITH {ROWS}, e AS (SELECT DISTINCT o_custkey, final FROM allp)
        SELECT c_mktsegment, CAST(count(*) FILTER (final = 'F') AS BIGINT) AS kept, CAST(count(*) FILTER (final <> 'F') AS BIGINT) AS skipped
        FROM e JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
    "seq_any_ending": f"WITH {ROWS} SELECT mstate AS state, move, CAST(count(*) AS BIGINT) AS n FROM allp GROUP BY ALL",
    "seq_max_ply_drop": f"WITH {ROWS} SELECT o_custkey, ply, pstate AS state, move FROM q WHERE n_plies <= 8",
    "seq_max_ply_truncate": f"WITH {ROWS} SELECT o_custkey, ply, pstate AS state, move FROM q WHERE ply <= 8",
    "seq_limit_per_source": f"""WITH {ROWS}, e AS (SELECT DISTINCT o_custkey, final, CAST(n_plies AS INTEGER) AS n_plies FROM allp),
        r AS (SELECT c_mktsegment, o_custkey, final, n_plies, row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_custkey) AS r FROM e JOIN customer ON c_custkey = o_custkey)
        SELECT c_mktsegment, o_custkey, n_plies FROM r WHERE r <= 20 AND final = 'F'""",
    "book_tally": f"WITH {PREFIX} SELECT * FROM book",
    "book_transposition": f"WITH {MULTI} SELECT * FROM book",
    "book_weighted": """SELECT l_returnflag || '>' || l_linestatus AS state, CAST(year(l_shipdate) AS VARCHAR) AS move, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
        FROM lineitem GROUP BY ALL""",
    "book_nested_ranked": f"WITH {MULTI} SELECT state, CAST(row_number() OVER (PARTITION BY state ORDER BY n DESC, move) AS INTEGER) AS rank, move, n FROM book",
    "book_ranked_top": f"""WITH {MULTI}, r AS (SELECT state, move, n, CAST(row_number() OVER (PARTITION BY state ORDER BY n DESC, move) AS INTEGER) AS rank FROM book)
        SELECT * FROM r WHERE rank <= 3""",
    "book_merge_two": f"WITH {ROWS} {TALLY}",
    "book_merge_many": f"WITH {ROWS} {TALLY}",
    "book_incremental_left_anti": f"WITH {ROWS} SELECT mstate AS state, move, CAST(count(*) AS BIGINT) AS n FROM q WHERE year(final_date) NOT IN (1995, 1996, 1997) GROUP BY ALL",
    "book_double_count": f"WITH {ROWS} SELECT mstate AS state, move, CAST(sum(CASE WHEN year(final_date) = 1998 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM q GROUP BY ALL",
    "book_stats": f"""WITH {MULTI} SELECT CAST(count(DISTINCT state) AS BIGINT) AS positions, CAST(count(*) AS BIGINT) AS entries,
        CAST(count(*) FILTER (state = '') AS BIGINT) AS root_moves, CAST(coalesce(sum(n) FILTER (state = ''), 0) AS BIGINT) AS root_total FROM book""",
    "lookup_point": f"WITH {MULTI}, {TOLD} SELECT '1>2' AS state, CAST(coalesce(b.total, 0) AS BIGINT) AS total, b.move, b.n, {SHARE} AS share, b.n / b.top * 100 AS bar FROM (SELECT 1) LEFT JOIN told b ON b.state = '1>2'",
    "lookup_batch": f"WITH {MULTI}, {TOLD}, {PROBES} SELECT p.state, CAST(coalesce(b.total, 0) AS BIGINT) AS total, b.move, b.n, {SHARE} AS share, b.n / b.top * 100 AS bar FROM probes p LEFT JOIN told b ON b.state = p.state",
    "lookup_nested": f"""WITH {MULTI}, {PROBES} SELECT p.state, CAST(coalesce(sum(n), 0) AS BIGINT) AS total, coalesce(string_agg(move || ':' || n, ',' ORDER BY n DESC, move), '') AS moves
        FROM probes p LEFT JOIN book b ON b.state = p.state GROUP BY p.state""",
    "lookup_unresolved_total": f"""WITH {MULTI}, {TOLD}, {PROBES}, tt AS (SELECT DISTINCT state, total FROM told)
        SELECT p.state, CAST(coalesce(tt.total, 0) AS BIGINT) AS total, b.move, b.n FROM probes p LEFT JOIN tt ON tt.state = p.state LEFT JOIN book b ON b.state = p.state AND b.move IN ('1', '2', '3', '4')""",
    "forced_states": f"WITH {PREFIX} SELECT state, min(move) AS move, min(n) AS n FROM book GROUP BY state HAVING count(*) = 1",
    "forced_playout": f"""WITH RECURSIVE {PREFIX}, k AS (SELECT state, count(*) AS choices, min(move) AS move FROM book GROUP BY state),
        walk AS (
            SELECT DISTINCT state AS start, state AS reached, 0 AS steps FROM book WHERE len(string_split(state, '>')) = 4
            UNION ALL
            SELECT start, reached || '>' || move, steps + 1 FROM walk JOIN k ON k.state = walk.reached WHERE choices = 1
        ), e AS (SELECT start, max(steps) AS steps, max_by(reached, steps) AS reached FROM walk GROUP BY start)
        SELECT start, reached AS "end", CAST(steps AS INTEGER) AS steps, CASE WHEN choices IS NULL THEN 'dry' WHEN choices = 1 THEN 'forced' ELSE 'choose' END AS phase FROM e LEFT JOIN k ON k.state = e.reached""",
    "phase_of_state": f"""WITH {PREFIX}, k AS (SELECT state, count(*) AS choices FROM book GROUP BY state),
        a AS (SELECT CASE WHEN pstate = '' THEN move ELSE pstate || '>' || move END AS state FROM q UNION SELECT state FROM book)
        SELECT a.state, CAST(coalesce(choices, 0) AS BIGINT) AS choices, CASE WHEN choices IS NULL THEN 'dry' WHEN choices = 1 THEN 'forced' ELSE 'choose' END AS phase FROM a LEFT JOIN k USING (state)""",
    "line_history": f"WITH {HISTORY} SELECT * FROM h",
    "line_history_delta": f"""WITH {HISTORY}, l AS (SELECT *, lag(total) OVER (PARTITION BY o_custkey ORDER BY ply) AS prev FROM h)
        SELECT o_custkey, ply, total, CASE WHEN total < prev THEN prev - total END AS delta FROM l""",
    "line_takeback": f"""WITH {HISTORY}, b AS (SELECT o_custkey, max(ply) AS n_plies, coalesce(max(ply) FILTER (choices > 1), 1) AS back_to FROM h GROUP BY o_custkey)
        SELECT o_custkey, n_plies, back_to, n_plies - back_to + 1 AS popped FROM b""",
    "line_ended_here": f"WITH {HISTORY} SELECT o_custkey, max_by(n, ply) AS total FROM h GROUP BY o_custkey",
    "line_move_rows": f"""WITH {ROWS}, r AS (
            SELECT o_custkey, ply, move, (ply + o_custkey) % 2 = 0 AS white,
                sum(CASE WHEN (ply + o_custkey) % 2 = 0 OR ply = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY ply) AS row FROM q
        ) SELECT o_custkey, CAST(row AS BIGINT) AS row, max(move) FILTER (white) AS white, max(move) FILTER (NOT white) AS black FROM r GROUP BY o_custkey, row""",
    "identify_unique": f"""WITH {GAMES}, pass AS (SELECT o_custkey AS game, mstate AS state, move AS target FROM q WHERE ply <= 50),
        l AS (SELECT game AS line, winner, array_to_string(list_sort(moves[1:least(len(moves) - 1, 49)]), '>') AS state, moves[least(len(moves) - 1, 49) + 1] AS target FROM g),
        hit AS (SELECT l.line, p.game, CASE WHEN g.winner = l.winner THEN p.game END AS same FROM l LEFT JOIN pass p ON p.state = coalesce(l.state, '') AND p.target = l.target LEFT JOIN g ON g.game = p.game)
        SELECT line, CASE WHEN count(game) = 1 THEN min(game) WHEN count(same) = 1 THEN min(same) END AS game, count(game) = 1 AS exact FROM hit GROUP BY line""",
    "identify_candidates": f"""WITH {GAMES}, l AS (SELECT array_to_string(moves[1:3], '>') AS line, game, len(moves) AS n FROM g),
        c AS (SELECT line, game FROM l WHERE n >= 5 UNION ALL SELECT line, game FROM l WHERE game % 2 = 0)
        SELECT line, CAST(count(*) AS BIGINT) AS n, CASE WHEN count(*) = 1 THEN min(game) END AS game FROM c GROUP BY line""",
    "targets_grouped": """WITH u AS (
            SELECT substr('abcdefgh', CAST(l_partkey % 8 AS INTEGER) + 1, 1) || '7' || substr('abcdefgh', CAST(l_suppkey % 8 AS INTEGER) + 1, 1) || '8' || substr('nbrq', l_linenumber % 4 + 1, 1) AS uci FROM lineitem
        ), c AS (SELECT uci, count(*) AS n FROM u GROUP BY uci)
        SELECT substr(uci, 1, 2) AS from_sq, substr(uci, 3, 2) AS to_sq, CAST(sum(n) AS BIGINT) AS total, string_agg(uci, ',' ORDER BY n DESC, uci) AS options FROM c GROUP BY ALL""",
    "dump_status": f"WITH {DUMPS} SELECT *, CASE WHEN size IS NOT NULL THEN {human('size')} END AS size_text FROM st",
    "dump_summary": f"""WITH {DUMPS} SELECT CAST(count(*) AS BIGINT) AS months, CAST(count(*) FILTER (downloaded = 'yes') AS BIGINT) AS n_downloaded,
        CAST(count(*) FILTER (processed = 'yes') AS BIGINT) AS n_processed FROM st""",
    "dump_match": f"""WITH {DUMPS} SELECT q, rank, tag FROM (VALUES ('2013'), ('LATEST'), ('12'), ('-'), ('1999')) v(q), d
        WHERE CASE WHEN lower(q) = 'latest' THEN rank = 0 ELSE contains(lower(tag), lower(q)) END""",
    "dump_pending": f"WITH {DUMPS} SELECT filename FROM f WHERE filename NOT IN (SELECT filename FROM m)",
    "manifest_union": f"""WITH {DUMPS}, u AS (SELECT filename, seq FROM m UNION ALL
            SELECT * FROM (VALUES ('extra.pgn', 2), ('lichess_db_standard_rated_2013-01.pgn.zst', 3), ('lichess_db_standard_rated_2013-02.pgn.zst', 4)) v(filename, seq))
        SELECT filename, CAST(min(seq) AS BIGINT) AS seq FROM u GROUP BY filename""",
    "fmt_compact": """WITH x AS (SELECT o_orderkey, CAST(floor(o_totalprice * pow(10, CAST(o_orderkey % 7 - 2 AS DOUBLE))) AS BIGINT) AS n FROM orders)
        SELECT o_orderkey, n, CASE WHEN n < 1000 THEN CAST(n AS VARCHAR)
            WHEN n < 10000 THEN regexp_replace(printf('%.1f', (n + CASE WHEN n % 250 = 0 THEN 1 ELSE 0 END) / 1000.0::DOUBLE), '\\.0$', '') || 'k' WHEN n < 1000000 THEN CAST(CAST(floor(n / 1000.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || 'k'
            WHEN n < 10000000 THEN regexp_replace(printf('%.1f', (n + CASE WHEN n % 250000 = 0 THEN 1 ELSE 0 END) / 1000000.0::DOUBLE), '\\.0$', '') || 'M' WHEN n < 1000000000 THEN CAST(CAST(floor(n / 1000000.0::DOUBLE + 0.5) AS BIGINT) AS VARCHAR) || 'M'
            ELSE printf('%.1f', n / 1000000000.0::DOUBLE) || 'B' END AS compact, format('{:,}', greatest(0, n)) AS digits FROM x""",
    "fmt_month": """SELECT o_orderkey, list_extract(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], month(o_orderdate)) || ' ' || year(o_orderdate) AS label, o_orderstatus AS other FROM orders""",
    "human_size": f"""WITH x AS (SELECT DISTINCT CAST(l_orderkey * l_partkey * pow(8, CAST(l_linenumber - 2 AS DOUBLE)) AS DOUBLE) AS d FROM lineitem), y AS (SELECT DISTINCT CAST(floor(d) AS BIGINT) AS n FROM x)
        SELECT n, {human('n')} AS size FROM y""",
    "move_pack_unpack": """WITH x AS (SELECT CAST(i % 64 AS INTEGER) AS origin, CAST(i // 64 % 64 AS INTEGER) AS target, CAST(CASE WHEN i // 4096 > 0 THEN i // 4096 + 1 ELSE 0 END AS INTEGER) AS promotion FROM range(20480) t(i))
        SELECT origin + 64 * target + 4096 * promotion AS packed, origin, target, promotion,
            chr(97 + origin % 8) || (origin // 8 + 1) || chr(97 + target % 8) || (target // 8 + 1) || CASE promotion WHEN 2 THEN 'n' WHEN 3 THEN 'b' WHEN 4 THEN 'r' WHEN 5 THEN 'q' ELSE '' END AS uci FROM x""",
}


def oracle_sql() -> dict:
    from . import more

    return ORACLES | more.ORACLES
