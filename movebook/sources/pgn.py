"""PGN as tables: text to games, games to replayed plies.

Files, zstd-compressed ones too, are read by Spark's text source, one row a
game.  A compressed file is one task, so the rows are dealt out again before
the replay, which is the part that costs.  The replay keeps one row a game with
arrays; plies come from it by an explode inside the JVM.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.chess import START, Position
from ..operators.identify import resolved

#: Positions that a worker keeps as a tree of openings.
TREE = 50_000
_TAG = re.compile(r'^\[(\w+)\s+"((?:[^"\\]|\\.)*)"\s*\]\s*$')
_RESULTS = frozenset(("1-0", "0-1", "1/2-1/2", "*"))
_SAN = re.compile(r"(?:[KQRBN]?[a-h]?[1-8]?[x-]?[a-h][1-8](?:=?[QRBN])?|[O0]-[O0](?:-[O0])?)[+#!?]*")


def read_games(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    """``source, at, text``: a row for each part that starts with an Event tag; ``limit`` counts per file, before any filter."""
    rows = spark.read.text(path, lineSep="\n[Event ").select(F.col("_metadata.file_name").alias("source"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), "value")
    text = F.when(F.col("value").startswith("[Event "), F.col("value")).otherwise(F.concat(F.lit("[Event "), F.col("value")))
    numbered = rows.select("source", "start", "id", text.alias("text"))
    if limit > 0:
        order = Window.partitionBy("source").orderBy("start", "id")
        numbered = numbered.withColumn("n", F.row_number().over(order)).where(F.col("n") <= limit)
    return numbered.select("source", F.col("id").alias("at"), "text")


def split_games(text: str):
    """(headers, movetext) of each game in a text; a header after moves starts another game."""
    headers, moves = {}, []
    for line in text.splitlines():
        tag = _TAG.match(line)
        if tag:
            if moves:
                yield headers, "\n".join(moves)
                headers, moves = {}, []
            headers[tag[1]] = tag[2]
        elif line.strip() and not line.startswith("%"):
            moves.append(line)
    if headers or moves:
        yield headers, "\n".join(moves)


def main_line(movetext: str) -> list[str]:
    """SAN of the main line: no comments, glyphs, variations, move numbers, results or unreadable tokens."""
    out, depth, i, n = [], 0, 0, len(movetext)
    while i < n:
        c = movetext[i]
        if c == "{":
            end = movetext.find("}", i)
            i = n if end < 0 else end + 1
        elif c == ";":
            end = movetext.find("\n", i)
            i = n if end < 0 else end + 1
        elif c in "()":
            depth = max(0, depth + (1 if c == "(" else -1))
            i += 1
        elif c.isspace():
            i += 1
        else:
            j = i
            while j < n and not movetext[j].isspace() and movetext[j] not in "{};()":
                j += 1
            token = re.sub(r"^\d+\.+", "", movetext[i:j]) if not movetext[i:j] in _RESULTS else ""
            if not depth and token and token[0] != "$" and _SAN.fullmatch(token):
                out.append(token)
            i = max(j, i + 1)
    return out


class Replayer:
    """Replays main lines; positions near the start are kept in a tree that is shared by all games."""

    def __init__(self):
        self.root, self.size = (Position.from_fen(START), {}), 0

    def __call__(self, headers: dict, sans: list[str]) -> tuple[str, list, list, list, Position]:
        """A verdict (ok, fen, variant, bad san) with keys, canonical indices and UCI of the plies."""
        node, keys, indices, ucis = self.root, [], [], []
        if "FEN" in headers:
            return "fen", [], [], [], node[0]
        if headers.get("Variant", "Standard") != "Standard":
            return "variant", [], [], [], node[0]
        for san in sans:
            position, children = node
            hit = children.get(san)
            if hit is None:
                move = position.from_san(san)
                if move is None:
                    return "bad san", [], [], [], position
                hit = (position.legal.index(move), position.uci(move), (position.play(move), {}))
                if self.size < TREE:
                    children[san] = hit
                    self.size += 1
            keys.append(position.key)
            indices.append(hit[0])
            ucis.append(hit[1])
            node = hit[2]
        return "ok", keys, indices, ucis, node[0]


REPLAYED = "source string, at bigint, nth int, headers map<string,string>, verdict string, n_plies int, ending string, winner string, keys array<bigint>, indices array<int>, ucis array<string>, final_key bigint, over boolean"


def replayed(games: DataFrame, max_ply: int = 0, mode: str = "drop", any_ending: bool = False) -> DataFrame:
    """One row a game; ``verdict`` is ok, or why it is skipped.

    A game with one bad move is skipped whole; so is one longer than
    ``max_ply``, unless ``mode`` is ``truncate``.  Only games that end in mate or
    stalemate on the board count, whatever their Result says, unless
    ``any_ending``; a game without a move never does.
    """
    if mode not in ("drop", "truncate"):
        raise ValueError(mode)

    def replay(batches):
        from ..functions.chess import line_winner

        replayer = Replayer()
        for batch in batches:
            rows = []
            for source, at, text in zip(*(c.to_pylist() for c in batch.columns)):
                for nth, (headers, moves) in enumerate(split_games(text or "")):
                    sans = main_line(moves)
                    long = 0 < max_ply < len(sans)
                    verdict, keys, indices, ucis, last = replayer(headers, sans[:max_ply] if long and mode == "truncate" else sans)
                    if verdict == "ok" and not keys:
                        verdict = "no moves"
                    elif verdict == "ok" and long and mode == "drop":
                        verdict = "too long"
                    elif verdict == "ok" and not any_ending and last.ending == "none":
                        verdict = "unfinished"
                    ok = verdict == "ok"
                    rows.append((source, at, nth, list(headers.items()), verdict, len(keys), last.ending if ok else None, line_winner(last) if ok else None, keys if ok else [], indices if ok else [], ucis if ok else [], last.key if ok else None, last.over if ok else None))
            columns = list(zip(*rows)) or [()] * 13
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["source", "at", "nth", "headers", "verdict", "n_plies", "ending", "winner", "keys", "indices", "ucis", "final_key", "over"])

    dealt = games.select("source", "at", "text").repartition(max(1, games.sparkSession.sparkContext.defaultParallelism))
    return dealt.mapInArrow(replay, REPLAYED)


def game_plies(games: DataFrame) -> DataFrame:
    """``source, at, nth, ply, pos_key, move_idx, uci`` of the games that count; the key is of the position before the move."""
    each = games.where("verdict = 'ok'").select("source", "at", "nth", F.posexplode(F.arrays_zip("keys", "indices", "ucis")).alias("p", "m"))
    return each.select("source", "at", "nth", (F.col("p") + 1).alias("ply"), F.col("m.keys").alias("pos_key"), F.col("m.indices").alias("move_idx"), F.col("m.ucis").alias("uci"))


def chess_tally(plies: DataFrame) -> DataFrame:
    """``source, pos_key, move_idx, uci, n``: kept by source, so that folding a source again replaces it."""
    return plies.groupBy("source", "pos_key", "move_idx").agg(F.first("uci").alias("uci"), F.count(F.lit(1)).alias("n"))


FEN_FACTS = "ok boolean, error string, pos_key bigint, fen string, legal array<struct<idx:int,uci:string,san:string>>"


def fen_facts(fens: DataFrame) -> DataFrame:
    """Adds ``facts`` to a table of ``fen``: error, key, and the legal moves in canonical order."""

    @F.pandas_udf(FEN_FACTS)
    def look(column):
        import pandas as pd

        from ..functions.chess import IllegalPosition, InvalidFen

        rows = []
        for fen in column:
            try:
                p = Position.from_fen(fen or "")
                rows.append((True, None, p.key, p.fen, [{"idx": i, "uci": p.uci(m), "san": p.san(m)} for i, m in enumerate(p.legal)]))
            except InvalidFen:
                rows.append((False, "invalid FEN", 0, None, []))
            except IllegalPosition:
                rows.append((False, "illegal position", 0, None, []))
        return pd.DataFrame(rows, columns=["ok", "error", "pos_key", "fen", "legal"])

    told = fens.withColumn("facts", look("fen"))
    return told.withColumn("facts", F.col("facts").withField("pos_key", F.when(F.col("facts.ok"), F.col("facts.pos_key"))))


def lookup_fens(book: DataFrame, fens: DataFrame) -> DataFrame:
    """``fen, error, total, uci, san, n``: known moves of each position, most played first by ``n``.

    The total counts moves that do not resolve to a legal one too.
    """
    asked = fen_facts(fens.select("fen").distinct()).select(F.col("fen").alias("asked"), "facts.*")
    sums = book.groupBy("pos_key", "move_idx").agg(F.sum("n").alias("n"))
    hits = asked.select("asked", "pos_key", "legal").join(sums, "pos_key")
    totals = hits.groupBy("asked").agg(F.sum("n").alias("total"))
    moves = hits.select("asked", "n", F.get("legal", F.col("move_idx").cast("int")).alias("m")).where("m is not null").select("asked", "n", "m.uci", "m.san")
    told = asked.select("asked", "error").join(totals, "asked", "left").join(moves, "asked", "left")
    return told.select(F.col("asked").alias("fen"), "error", F.coalesce("total", F.lit(0)).alias("total"), "uci", "san", "n")


def identify_lines(lines: DataFrame, games: DataFrame, depth: int = 49) -> DataFrame:
    """``line, at, exact`` for lines ``line, ucis``: by position, so that transposed games count too."""

    @F.pandas_udf("state bigint, target string, winner string")
    def anchor(column):
        import pandas as pd

        from ..functions.chess import line_winner

        rows = []
        for ucis in column:
            p, state, target = Position.from_fen(START), 0, None
            for i, uci in enumerate(ucis):
                if i == min(len(ucis) - 1, depth):
                    state, target = p.key, uci
                move = p.from_uci(uci)
                if move is None:
                    target = None
                    break
                p = p.play(move)
            rows.append((state, target, line_winner(p)))
        return pd.DataFrame(rows, columns=["state", "target", "winner"])

    asked = lines.where("size(ucis) between 1 and 1024").withColumn("a", anchor("ucis")).select("line", "a.*")
    each = games.where("verdict = 'ok'").select(F.col("at").alias("game"), "winner", F.posexplode(F.arrays_zip("keys", "ucis")).alias("p", "m"))
    passing = each.where(F.col("p") <= depth).select("game", "winner", F.col("m.keys").alias("state"), F.col("m.ucis").alias("target"))
    return resolved(asked, passing).withColumnRenamed("game", "at")


def playout(games: DataFrame, starts: DataFrame) -> DataFrame:
    """``start, end, steps, phase`` of positions ``start`` (keys): where single known moves lead.

    The phase is over where the game has ended on the board, dry without a
    known move, choose with several, and cycle where single moves come back
    to where they were.
    """
    from ..operators.line import doubled

    ok = games.where("verdict = 'ok'")
    after = F.concat(F.slice("keys", 2, F.size("keys")), F.array("final_key"))
    steps = ok.select(F.explode(F.arrays_zip(F.col("keys"), F.col("indices"), after.alias("after"))).alias("m")).select(F.col("m.keys").alias("state"), F.col("m.indices").alias("move"), F.col("m.after").alias("to"))
    known = steps.groupBy("state").agg(F.countDistinct("move").alias("choices"), F.min("to").alias("to"))
    over = ok.where("over").select(F.col("final_key").alias("state"), F.lit(True).alias("over")).distinct()
    marked = known.join(over, "state", "full").select("state", F.coalesce("choices", F.lit(0)).alias("choices"), "to", F.coalesce("over", F.lit(False)).alias("over"))
    jump = doubled(marked.where("choices = 1 and not over").select("state", "to", F.lit(1).alias("steps")))
    played = starts.select("start").distinct().join(jump.withColumnRenamed("state", "start"), "start", "left")
    ends = played.select("start", F.coalesce("to", "start").alias("end"), F.coalesce("steps", F.lit(0)).alias("steps"))
    told = ends.join(marked.select(F.col("state").alias("end"), "choices", "over"), "end", "left")
    phase = F.when(F.col("over"), "over").when(F.coalesce("choices", F.lit(0)) == 0, "dry").when(F.col("choices") == 1, "cycle").otherwise("choose")
    return told.select("start", "end", F.when(phase == "cycle", F.lit(None)).otherwise(F.col("steps")).alias("steps"), phase.alias("phase"))


POSITION_FACTS = "error string, fen string, pos_key bigint, ending string, check_square string, result string, castling array<struct<packed:int,uci:string,san:string>>"


def position_facts(fens: DataFrame) -> DataFrame:
    """Adds ``facts`` to a table of ``fen``: the canonical FEN, key, ending, king in check, result's text and castling moves."""

    @F.pandas_udf(POSITION_FACTS)
    def look(column):
        import pandas as pd

        from ..functions.chess import IllegalPosition, InvalidFen, result_text

        rows = []
        for fen in column:
            try:
                p = Position.from_fen(fen or "")
            except (InvalidFen, IllegalPosition) as e:
                rows.append(("invalid FEN" if isinstance(e, InvalidFen) else "illegal position", None, 0, None, None, None, []))
                continue
            castling = [{"packed": m, "uci": p.uci(m), "san": p.san(m)} for m in p.legal if p.is_castling(m)]
            rows.append((None, p.fen, p.key, p.ending, p.king_in_check, result_text(p), castling))
        return pd.DataFrame(rows, columns=["error", "fen", "pos_key", "ending", "check_square", "result", "castling"])

    return fens.withColumn("facts", look("fen"))


def movetext_lines(lines: DataFrame) -> DataFrame:
    """``line, plies, play, before_last, last`` of ``line, movetext``: UCI moves and the FEN before the last one.

    All are null where a move can't be played.
    """

    @F.pandas_udf("plies int, play string, before_last string, last string")
    def play(column):
        import pandas as pd

        rows = []
        for text in column:
            position = before = Position.from_fen(START)
            ucis: list | None = []
            for token in (text or "").split():
                if token.endswith(".") or token in _RESULTS:
                    continue
                move = position.from_san(token.rstrip("!?"))
                if move is None:
                    ucis = None
                    break
                before = position
                ucis.append(position.uci(move))
                position = position.play(move)
            rows.append((None, None, None, None) if ucis is None else (len(ucis), ",".join(ucis), before.fen, ucis[-1] if ucis else None))
        return pd.DataFrame(rows, columns=["plies", "play", "before_last", "last"]).astype({"plies": "Int32"})

    return lines.withColumn("told", play("movetext")).select("line", "told.*")
