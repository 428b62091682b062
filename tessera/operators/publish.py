"""Versioned packs of a catalogue, the manifest that lists them, and a client's way from one version to another."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..scratch import free_shuffles, new_dir, scope, written
from .merge import Snapshots, delete_keys, merge_lww
from .refresh import record_versions

MANIFEST_DELTAS, CHAIN_LIMIT = 14, 64

RENAMED = {
    "sets": {"id": "id", "game_id": "gameId", "code": "code", "name": "name", "release_date": "releaseDate"},
    "cards": {"id": "id", "game_id": "gameId", "name": "name", "art_id": "artId"},
    "printings": {
        "id": "id", "card_id": "cardId", "game_id": "gameId", "set_id": "setId", "number": "number", "set_total": "setTotal", "rarity": "rarity",
        "variant": "variant", "language": "language", "tcgplayer_product_id": "tcgplayerProductId", "image_url": "imageUrl", "updated_at": "updatedAt",
    },
    "prices": {"printing_id": "printingId", "source": "source", "currency": "currency", "market": "market", "low": "low", "trend": "trend", "avg7": "avg7", "avg30": "avg30", "as_of": "asOf"},
}


def shown(rows: DataFrame, table: str) -> DataFrame:
    """The columns that a pack shows, under its names."""
    return rows.select(*[F.col(a).alias(b) for a, b in RENAMED[table].items() if a in rows.columns])


def full_pack(tables: dict[str, DataFrame], game: str) -> dict[str, DataFrame]:
    """Everything that a first install of a game needs, by table."""
    mine = {n: tables[n].where(F.col("game_id") == game) for n in ("sets", "cards", "printings")}
    prices = tables["prices"].join(mine["printings"].select(F.col("id").alias("printing_id")), "printing_id", "left_semi")
    return {n: shown(df, n) for n, df in (mine | {"prices": prices}).items()}


def delta_pack(tables: dict[str, DataFrame], game: str, since: Column) -> dict[str, DataFrame]:
    """What changed after `since`: printings and prices by time, and the cards of the changed printings. Never sets."""
    mine = tables["printings"].where(F.col("game_id") == game)
    changed = mine.where(F.col("updated_at") > since)
    cards = tables["cards"].where(F.col("game_id") == game).join(changed.select(F.col("card_id").alias("id")).distinct(), "id", "left_semi")
    prices = tables["prices"].where(F.col("as_of") > since).join(mine.select(F.col("id").alias("printing_id")), "printing_id", "left_semi")
    return {"sets": shown(tables["sets"].limit(0), "sets"), "cards": shown(cards, "cards"), "printings": shown(changed, "printings"), "prices": shown(prices, "prices")}


def full_pack_of_all(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The full packs of all games in one pass over each table (prices with game_id), with `game`."""
    return {n: tables[n].select(F.col("game_id").alias("game"), *[F.col(a).alias(b) for a, b in RENAMED[n].items() if a in tables[n].columns]) for n in RENAMED}


#: A pack's lists of what went, for each of its tables; readers of the first form know removedPrintings alone.
GONE = {"printings": "removedPrintings", "sets": "removedSets", "cards": "removedCards", "prices": "removedPrices"}
#: A pack's lists in the order of its document.
SECTIONS = ("sets", "cards", "printings", "prices", "removedPrintings")
MORE_SECTIONS = tuple(g for g in GONE.values() if g not in SECTIONS)


def quoted(c: Column) -> Column:
    """A string as JSON: a list of one, without its brackets."""
    return F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")


def document_lines(sections: dict[str, DataFrame], heads: DataFrame) -> DataFrame:
    """doc, section, kind, value: the lines of the documents of heads (doc, game, from, to), without the commas between the
    rows of a list: a head, then each list, a row a line. sections: rows with `game`."""
    names = [n for n in (*SECTIONS, *MORE_SECTIONS) if n in SECTIONS or n in sections]
    start = F.coalesce(quoted(F.col("from")), F.lit("null"))
    start = F.when(F.col("from").isNull(), F.lit("null")).otherwise(start)
    head = F.concat(F.lit('{"game":'), quoted(F.col("game")), F.lit(',"from":'), start, F.lit(',"to":'), quoted(F.col("to")))
    fixed = [(0, head), *[(i, F.lit(f',"{n}":[')) for i, n in enumerate(names, 1)], *[(i, F.lit("]")) for i, _ in enumerate(names, 1)], (len(names) + 1, F.lit("}"))]
    kind = [0] * (len(names) + 1) + [2] * (len(names) + 1)
    lines = F.array(*[F.struct(F.lit(i).alias("section"), F.lit(k).alias("kind"), v.alias("value")) for (i, v), k in zip(fixed, kind, strict=True)])
    out = heads.select("doc", F.explode(lines).alias("x")).select("doc", "x.*")
    for i, name in enumerate(names, 1):
        if name in sections:
            rows = sections[name].join(F.broadcast(heads.select("doc", "game")), "game").drop("game")
            columns = [c for c in rows.columns if c != "doc"]
            value = quoted(F.col(columns[0])) if name in GONE.values() and len(columns) == 1 else F.to_json(F.struct(*columns))
            out = out.unionByName(rows.select("doc", F.lit(i).alias("section"), F.lit(1).alias("kind"), value.alias("value")))
    return out


def with_commas(lines: DataFrame) -> DataFrame:
    """doc, value: the lines of each document in order, with commas before all rows of a list but the first."""
    order = Window.partitionBy("doc").orderBy("section", "kind", "value")
    again = (F.col("kind") == 1) & F.lag(F.col("section") * 3 + F.col("kind")).over(order).eqNullSafe(F.col("section") * 3 + F.col("kind"))
    return lines.withColumn("value", F.concat(F.when(again, ",").otherwise(""), "value")).select("doc", "value")


def write_documents(sections: dict[str, DataFrame], heads: DataFrame) -> list[str]:
    """Writes one JSON document for each of heads (game, from, to, path), of the rows of sections with its game; the paths.

    A document is one file, as the format asks for: one task sorts its lines (on disk, where they are many) and streams them
    out, other documents' tasks beside it. Files take their names when all are whole.
    """
    spark = heads.sparkSession
    rows = sorted(tuple(r) for r in heads.select("path", "game", "from", "to").collect())  # one for each document
    if not rows:
        return []
    heads = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "doc int, game string, `from` string, `to` string")
    with scope(spark):
        parts = new_dir(spark, "packs")
        with_commas(document_lines(sections, heads)).write.partitionBy("doc").text(parts)
        path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
        for i, (path, *_) in enumerate(rows):
            target = path_of(path)
            store = target.getFileSystem(conf)
            (part,) = [f.getPath() for f in store.globStatus(path_of(f"{parts}/doc={i}/part-*"))]
            store.mkdirs(target.getParent())
            store.delete(target, False)
            if not store.rename(part, target):
                raise OSError(f"{path} could not be written")
    free_shuffles(spark)
    return [r[0] for r in rows]


def write_pack(pack: dict[str, DataFrame], path: str, game: str, start: str | None, to: str) -> str:
    """A pack as one JSON file of that name (see write_documents). `removed` of pack (id) is the list of removed printings."""
    sections = {GONE["printings"] if n == "removed" else n: rows.withColumn("game", F.lit(game)) for n, rows in pack.items()}
    spark = pack["printings"].sparkSession
    write_documents(sections, spark.createDataFrame([(game, start, to, path)], "game string, `from` string, `to` string, path string"))
    return path


KINDS = {"updatedAt": "timestamp", "asOf": "timestamp", "tcgplayerProductId": "bigint"} | dict.fromkeys(("market", "low", "trend", "avg7", "avg30"), "double")


def row_schema(table: str) -> str:
    return ",".join(f"{b}:{KINDS.get(b, 'string')}" for b in RENAMED[table].values())


def read_pack(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a pack's document under the names of the catalogue's columns, with `seq` (their place in it), and
    `removed`. Absent lists are empty. A document is one row to Spark: it must fit a task's memory (see read_documents)."""
    schema = ", ".join(["game string, `from` string, `to` string", *[f"{t} array<struct<{row_schema(t)}>>" for t in RENAMED], "removedPrintings array<string>"])
    whole = spark.read.schema(schema).json(path, multiLine=True)
    out = {}
    for t, names in RENAMED.items():
        rows = whole.select(F.posexplode(t).alias("seq", "x"))
        out[t] = rows.select(*[F.col(f"x.{b}").alias(a) for a, b in names.items()], "seq")
    return out | {"removed": whole.select(F.explode("removedPrintings").alias("id"))}


def read_documents(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """The tables of many documents with a row a line (as write_documents makes them), and the keys of what they removed
    (under the lists' names): the catalogue's columns, `doc` (the place of the path) and `seq` (which sorts a document's rows).

    Files are split by ranges of bytes at their lines. A line's list is the last whose head comes before it: of those there
    are a handful a document, and they are broadcast.
    """
    bare = F.regexp_replace(F.col("_metadata.file_path"), "^[a-z0-9]+:/+", "/")
    known = spark.createDataFrame([(re.sub("^[a-z0-9]+:/+", "/", p), i) for i, p in enumerate(paths)], "path string, doc int")
    lines = spark.read.text(paths).select("value", bare.alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n")).alias("seq"))
    lines = written(lines.join(F.broadcast(known), "path").drop("path"), "documents")
    name = F.regexp_extract("value", r'^,"(\w+)":\[$', 1)
    heads = lines.select("doc", name.alias("name"), "seq").where("name <> ''").groupBy("doc").agg(F.collect_list(F.struct("seq", "name")).alias("heads"))
    rows = lines.where(F.col("value").rlike(r'^,?[{"]') & (name == "")).join(F.broadcast(heads), "doc")
    last = F.array_max(F.filter("heads", lambda h: h["seq"] < F.col("seq")))
    rows = rows.select("doc", "seq", last["name"].alias("name"), F.regexp_replace("value", "^,", "").alias("value"))
    out = {}
    for t, names in RENAMED.items():
        here = rows.where(F.col("name") == t).withColumn("x", F.from_json("value", f"struct<{row_schema(t)}>"))
        out[t] = here.select(*[F.col(f"x.{b}").alias(a) for a, b in names.items()], "doc", "seq")
        key, gone = CLIENT_UPDATES[t][0], rows.where(F.col("name") == GONE[t])
        if len(key) == 1:
            out[GONE[t]] = gone.select(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "array<string>")[0].alias(key[0]), "doc")
        else:
            out[GONE[t]] = gone.withColumn("x", F.from_json("value", ", ".join(f"{k} string" for k in key))).select("x.*", "doc")
    return out


def publish(tables: dict[str, DataFrame], game: str, version: str, root: str, previous: tuple[str, Column] | None = None) -> list[str]:
    """Writes the full pack, and a delta from the previous version (its name and time) unless that is the same one."""
    paths = [write_pack(full_pack(tables, game), f"{root}/games/{game}/catalog-{version}.json", game, None, version)]
    if previous is not None and previous[0] != version:
        delta = delta_pack(tables, game, previous[1])
        paths.append(write_pack(delta, f"{root}/games/{game}/delta-{previous[0]}-{version}.json", game, previous[0], version))
    return paths


def publish_next(tables: dict[str, DataFrame], versions: DataFrame, game: str, version: str, now: datetime, root: str) -> tuple[list[str], DataFrame]:
    """Publishes a game's next version after the newest that `versions` has, and gives the packs' paths and versions
    (game_id, version, printings_count, index_pack_key, created_at) with it; a version published again keeps its time."""
    last = versions.where(F.col("game_id") == game).orderBy(F.desc("created_at"), F.desc("version")).select("version", "created_at").first()
    paths = publish(tables, game, version, root, (last[0], F.lit(last[1])) if last else None)
    count = tables["printings"].where(F.col("game_id") == game).count()
    kinds = {f.name: f.dataType for f in versions.schema}
    values = {"game_id": game, "version": version, "printings_count": count, "index_pack_key": None, "created_at": now}
    new = versions.sparkSession.range(1).select(*[F.lit(values[c]).cast(kinds[c]).alias(c) for c in versions.columns], F.lit(0).alias("seq"))
    return paths, record_versions(versions, new)


def manifest(versions: DataFrame, origin: str, base: str | None = None) -> DataFrame:
    """One row for each game: its newest version, addresses of its packs, and its latest deltas, newest first.

    versions: game_id, version, printings_count, index_pack_key, created_at. The index is the newest version's own, or
    else the latest that the game has. Versions of equal time are taken in falling order of their names.
    """
    at = F.struct("created_at", "version")
    newest = F.max_by(F.struct("version", "printings_count", "index_pack_key"), at).alias("v")
    index = F.max_by("index_pack_key", F.when(F.col("index_pack_key").isNotNull() & (F.col("index_pack_key") != ""), at)).alias("latest_key")
    order = Window.partitionBy("game_id").orderBy(F.desc("created_at"), F.desc("version"))
    steps = versions.withColumn("n", F.row_number().over(order)).withColumn("to", F.lag("version").over(order))
    steps = steps.where(F.col("n").between(2, MANIFEST_DELTAS + 1))
    url = lambda key: T.pack_url(F.lit(origin), F.lit(base).cast("string"), key)
    steps = steps.select("game_id", "n", F.col("version").alias("from"), "to", url(T.pack_key(F.col("game_id"), "delta", F.col("version"), F.col("to"))).alias("url"))
    deltas = steps.groupBy("game_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "from", "to", "url"))), lambda d: F.struct(d["from"], d["to"], d["url"])).alias("deltas"))
    key = F.coalesce("v.index_pack_key", "latest_key")
    out = versions.groupBy("game_id").agg(newest, index).join(deltas, "game_id", "left")
    return out.select(
        F.col("game_id").alias("game"),
        "v.version",
        F.col("v.printings_count").alias("printingsCount"),
        url(T.pack_key(F.col("game_id"), "catalog", F.col("v.version"))).alias("catalogUrl"),
        url(key).alias("indexUrl"),
        url(T.ids_key(key)).alias("indexIdsUrl"),
        F.coalesce("deltas", F.array().cast("array<struct<from:string,to:string,url:string>>")).alias("deltas"),
    )


def delta_chain(deltas: DataFrame, wanted: DataFrame, limit: int = CHAIN_LIMIT) -> DataFrame:
    """game, step, from, to: the deltas to apply in order; no row where there is no whole chain, or nothing to do.

    deltas: game, from, to, ordinal (of several from one version the last counts). wanted: game, local, target.

    By pointer doubling: jumps of 1, 2, 4 ... links are made by joining each with itself, and every version reached is
    taken on by the next jump, so a chain of `limit` links costs log2(limit) joins, whatever the number of games. Once no
    walk goes on, none of more links does, and no longer jump is made.
    """
    start = wanted.where(F.col("local").isNotNull() & (F.col("local") != "") & (F.col("local") != F.col("target")))
    links = deltas.join(start.select("game").distinct(), "game", "left_semi").groupBy("game", "from").agg(F.max_by("to", "ordinal").alias("to"))
    jump = links = written(links, "chain-links")
    walked, length = start.select("game", "local", "target", F.col("local").alias("at"), F.lit(0).alias("step")), 1
    while length <= limit:
        far = walked.join(jump.select("game", F.col("from").alias("at"), F.col("to").alias("far")), ["game", "at"])
        new = written(far.select("game", "local", "target", F.col("far").alias("at"), (F.col("step") + length).alias("step")).where("at IS NOT NULL"), "chain-walks")
        if new.isEmpty():
            break
        walked = walked.union(new)
        length *= 2
        if length <= limit:
            left, right = jump.select("game", "from", F.col("to").alias("mid")), jump.select("game", F.col("from").alias("mid"), "to")
            jump = written(left.join(right, ["game", "mid"]).select("game", "from", "to"), "chain-jumps")
    ends = F.min(F.when(F.col("at") == F.col("target"), F.col("step"))).over(Window.partitionBy("game", "local", "target"))
    steps = walked.withColumn("end", ends).where((F.col("end") <= limit) & (F.col("step") < F.col("end")))
    return steps.join(links.withColumnRenamed("from", "at"), ["game", "at"]).select("game", (F.col("step") + 1).alias("step"), F.col("at").alias("from"), "to")


#: A client updates more of a row than the server.
CLIENT_UPDATES = {
    "sets": (["id"], ["code", "name", "release_date"]),
    "cards": (["id"], ["name", "art_id"]),
    "printings": (["id"], ["set_id", "number", "set_total", "rarity", "variant", "language", "tcgplayer_product_id", "updated_at"]),
    "prices": (["printing_id", "source"], ["currency", "market", "low", "trend", "avg7", "avg30", "as_of"]),
}


def apply_delta(tables: dict[str, DataFrame], delta: dict[str, DataFrame], removed: DataFrame | None = None) -> dict[str, DataFrame]:
    """A client's tables after a delta, each with the table's columns and `seq`; removed printings (id) go last."""
    out = dict(tables)
    for name, (key, update) in CLIENT_UPDATES.items():
        if name in delta and name in tables:
            out[name] = merge_lww(tables[name], delta[name], key, "seq", [c for c in update if c in tables[name].columns])
    if removed is not None:
        out["printings"] = delete_keys(out["printings"], removed, ["id"])
    return out


#: What a client takes where a pack leaves a column out.
DEFAULTS = {"variant": "normal", "language": "en"}


def with_defaults(rows: DataFrame, now: Column) -> DataFrame:
    """A pack's rows with defaults in place of nulls, and `now` for missing times."""
    given = {c: F.lit(v) for c, v in DEFAULTS.items()} | {"updated_at": now}
    return rows.select(*[F.coalesce(c, given[c]).alias(c) if c in given else F.col(c) for c in rows.columns])


def sync(tables: dict[str, DataFrame], chain: list[dict[str, DataFrame]], full: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """A client's tables after a chain of deltas in order; without a chain, after the full pack (upserted, as deltas are)."""
    for delta in chain or ([full] if full else []):
        tables = apply_delta(tables, delta, delta.get("removed"))
    return tables


def sync_store(store: Snapshots, chain: list[dict[str, DataFrame]], full: dict[str, DataFrame] | None = None) -> int:
    """Brings a client's stored tables up to date in one new version, so that no reader sees half a delta."""
    return store.write(sync(store.read(), chain, full))


def stale_games(versions: DataFrame, cutoff: Column) -> DataFrame:
    """game_id, latest of games whose newest version is older than the cutoff, the stalest first."""
    return versions.groupBy("game_id").agg(F.max("created_at").alias("latest")).where(F.col("latest") < cutoff).orderBy("latest", "game_id")


def due_game(progress: DataFrame, versions: DataFrame, cutoff: Column) -> DataFrame:
    """The one game to import next: the oldest unfinished import, else the stalest version."""
    running = progress.where("done_at IS NULL").select("game_id", F.lit(0).alias("kind"), F.col("updated_at").cast("timestamp").alias("at"))
    stale = stale_games(versions, cutoff).select("game_id", F.lit(1).alias("kind"), F.col("latest").cast("timestamp").alias("at"))
    return running.unionByName(stale).orderBy("kind", F.asc_nulls_first("at"), "game_id").limit(1).select("game_id")


def newest_at_most(keys: DataFrame, pattern: str = r"^games/([^/]+)/index-([0-9]{8})\.bin$") -> DataFrame:
    """game, version: the newest stored index of each game no later than `at_most`, of keys (key, at_most)."""
    parts = keys.where(F.col("key").rlike(pattern)).select(F.regexp_extract("key", pattern, 1).alias("game"), F.regexp_extract("key", pattern, 2).alias("version"), "at_most")
    return parts.where("version <= at_most").groupBy("game").agg(F.max("version").alias("version"))
