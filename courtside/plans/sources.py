"""Sources and sinks at work on the supplied tables: raw folders, CSV and JSON documents written and read again, damaged lines, compact logs."""
from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.registry import query
from courtside.sources.logs import LOGS, log_rows
from courtside.sources.raw_folder import read_csv, read_raw, slice_of, write_bodies, write_csv
from courtside.sources.storage import fresh_path, read_lenient
from courtside.sources.tables import GAMES, games, table


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tournament, day, body): a document for each order, tournaments by its priority, days the first of its month."""
    o = table(spark, sf_dir, "orders")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("match"), (F.col("o_orderkey") % 5 != 0).alias("doubles"), F.col("o_totalprice").alias("total")))
    return o.select(F.col("o_orderpriority").alias("tournament"), F.trunc("o_orderdate", "month").alias("day"), body.alias("body"))


def _folder(spark: SparkSession, rows: DataFrame, name: str) -> str:
    path = fresh_path(spark, name)
    write_bodies(rows, path)
    return path


_DOCS = "docs as (select o_orderpriority tournament, cast(date_trunc('month', o_orderdate) as date) \"day\", o_orderkey \"match\", o_orderkey % 5 <> 0 doubles, o_totalprice total from orders)"


@query(f"with {_DOCS} select tournament, \"day\", \"match\", total from docs where doubles and \"day\" between date '1995-03-01' and date '1996-08-31' and tournament in ('1-URGENT', '3-MEDIUM')")
def raw_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Doubles of two tournaments and eighteen months out of a folder of raw documents: other tournaments' and days' files are never opened."""
    raw = read_raw(spark, _folder(spark, order_documents(spark, sf_dir), "raw"), "folder")
    asked = slice_of(raw, datetime.date(1995, 3, 1), datetime.date(1996, 8, 31), ["1-URGENT", "3-MEDIUM"])
    m = asked.select("tournament", "day", F.from_json("body", "match long, doubles boolean, total double").alias("m"))
    return m.where("m.doubles").select("tournament", "day", "m.match", "m.total")


@query(f"with {_DOCS} select tournament, \"day\", count(*) n, sum(\"match\") matches from docs group by all", matches="bigint")
def raw_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the raw folder, counted by tournament and day."""
    raw = read_raw(spark, _folder(spark, order_documents(spark, sf_dir), "raw"), "folder")
    return raw.groupBy("tournament", "day").agg(F.count("*").alias("n"), F.sum(F.get_json_object("body", "$.match").cast("long")).alias("matches"))


CSV_HEADER = ["gid", "date", "title", "s1", "s2", "is_forfeit"]


@query(f"""with {GAMES} select gid, "date", case when game_no % 7 = 0 then null when game_no % 5 = 0 then '' else tour || ', "' || context || '"' end title, s1, s2, is_forfeit from games""")
def csv_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games written as CSV with a fixed header and read again with a schema: commas, quotes, empty and missing text come back as they were."""
    title = F.when(F.col("game_no") % 7 == 0, None).when(F.col("game_no") % 5 == 0, "").otherwise(F.concat("tour", F.lit(', "'), "context", F.lit('"')))
    path = fresh_path(spark, "csv")
    write_csv(games(spark, sf_dir).withColumn("title", title), path, CSV_HEADER)
    return read_csv(spark, path, "gid string, date date, title string, s1 int, s2 int, is_forfeit boolean")


@query(f"""with {GAMES}, m as (select match_id, game_no, max(struct_pack(gid := gid, s1 := s1, s2 := s2, a1 := a1, a2 := a2, b1 := b1, b2 := b2)) x from games group by all),
g as (select match_id, game_no, x.s1 || '-' || x.s2 score, x.a1 a1, x.a2 a2, x.b1 b1, x.b2 b2 from m)
select match_id, list_sort(list_distinct(flatten(list([a1, a2])))) one, list_sort(list_distinct(flatten(list([b1, b2])))) other, string_agg(game_no || ':' || score, ',' order by game_no) games from g group by match_id""")
def match_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested document a match (both sides' players as sets, a map of games to scores), written as JSON to a raw folder and read again by one typed schema. Of a game's repeated rows the last by id and score counts."""
    g = games(spark, sf_dir).groupBy("match_id", "game_no").agg(F.max(F.struct("gid", "s1", "s2", "a1", "a2", "b1", "b2", "date")).alias("p"))
    side = lambda x, y: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array(f"p.{x}", f"p.{y}")))))
    scores = F.map_from_entries(F.collect_list(F.struct(F.col("game_no").cast("string"), F.struct("p.s1", "p.s2"))))
    docs = g.groupBy("match_id").agg(F.trunc(F.min("p.date"), "year").alias("day"), side("a1", "a2").alias("one"), side("b1", "b2").alias("other"), scores.alias("games"))
    rows = docs.select(F.lit("all").alias("tournament"), "day", F.to_json(F.struct("match_id", "one", "other", "games")).alias("body"))
    raw = read_raw(spark, _folder(spark, rows, "documents"), "folder")
    m = raw.select(F.from_json("body", "match_id long, one array<long>, other array<long>, games map<string, struct<s1: int, s2: int>>").alias("m")).select("m.*")
    in_order = F.array_sort(F.transform(F.map_entries("games"), lambda e: F.struct(e.key.cast("int").alias("no"), F.concat_ws("-", e.value.s1, e.value.s2).alias("score"))))
    return m.select("match_id", "one", "other", F.array_join(F.transform(in_order, lambda x: F.concat_ws(":", x["no"], x["score"])), ",").alias("games"))


@query("""select event_type, count(*) filter (where event_id % 11 <> 0) good, count(*) filter (where event_id % 11 = 0) corrupt, cast(coalesce(sum(event_id) filter (where event_id % 11 <> 0), 0) as bigint) ids from events group by event_type""")
def corrupt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appended lines of which some were cut off while they were written: whole ones are read, the others kept apart with their text."""
    line = F.to_json(F.struct("event_type", "event_id", "user_id"))
    cut = F.when(F.col("event_id") % 11 == 0, F.substring(line, F.lit(1), F.length(line) - 3)).otherwise(line)
    path = fresh_path(spark, "lines")
    table(spark, sf_dir, "events").select(cut.alias("value")).write.text(path)
    rows, bad = read_lenient(spark, path, "event_type string, event_id long, user_id long")
    kind = F.regexp_extract("_corrupt", '"event_type":"([^"]*)"', 1)
    both = rows.select("event_type", "event_id").unionByName(bad.select(kind.alias("event_type"), F.lit(None).cast("long").alias("event_id")))
    return both.groupBy("event_type").agg(F.count("event_id").alias("good"), F.count_if(F.col("event_id").isNull()).alias("corrupt"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("ids"))


#: Parts of a log row that say which team it is about, by rank.
TEAM_PARTS = ("timeout_log", "additional_timeout_log", "challenge_log", "video_challenge_log", "line_review_log")
LOG_ROW = ", ".join(["log_index long, log_type int, game_number int, start_score_current_game_string string, end_score_current_game_string string, server_uuid string, server_index int, date_created string, LogData map<string, string>", *(f"{t} struct<team_uuid: string>" for t in TEAM_PARTS)])


def compact_log(body):
    """A log row's JSON with nine short fields of it: of what it is about only the team, of its time only the second.

    The team comes from the first part that names one, in archived rows at the top, in streamed ones below LogData (there by the part's name). Times are a
    document with seconds, seconds, or ISO text (UTC); anything else is null. A body that is no JSON gives null.
    """
    r = F.from_json(body, LOG_ROW)
    named = lambda x: F.nullif(x, F.lit(""))
    nested = F.array_sort(F.map_entries(r["LogData"]))
    streamed = F.array_compact(F.transform(nested, lambda e: named(F.get_json_object(e["value"], "$.team_uuid"))))
    team = F.coalesce(*(named(r[t]["team_uuid"]) for t in TEAM_PARTS), F.get(streamed, F.lit(0)))
    made = r["date_created"]
    second = F.when(made.startswith("{"), F.get_json_object(made, "$.seconds").try_cast("long")).otherwise(F.coalesce(made.try_cast("long"), F.unix_seconds(made.try_cast("timestamp"))))
    text = lambda x: F.lower(F.coalesce(x, F.lit("")))
    short = F.struct(
        F.coalesce(r["log_index"], F.lit(0)).alias("i"), F.coalesce(r["log_type"], F.lit(0)).alias("t"), F.coalesce(r["game_number"], F.lit(1)).alias("g"), F.coalesce(r["start_score_current_game_string"], F.lit("")).alias("s"),
        F.coalesce(r["end_score_current_game_string"], F.lit("")).alias("e"), text(r["server_uuid"]).alias("sv"), F.coalesce(r["server_index"], F.lit(0)).alias("n"), second.alias("ts"), F.lower(team).alias("team"))
    return F.when(r.isNotNull() & body.rlike(r"^\s*\{"), F.to_json(short))


@query(f"""with {LOGS} select log_index, '{{"i":' || log_index || ',"t":' || log_type || ',"g":' || game_number || ',"s":"' || start_string || '","e":"' || end_string || '","sv":"' || lower(server_uuid) || '","n":' || log_index % 2
|| case when log_index % 4 = 0 then '' else ',"ts":' || (1700000000 + log_index % 86400) end || case when team_uuid is null or log_index % 5 = 0 then '' else ',"team":"' || lower(team_uuid) || '"' end || '}}' compact from logs""")
def compact_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All log rows as a source sends them (times in four forms, teams in archived or streamed place, and parts nobody reads), made compact."""
    at = F.col("log_index") % 86400 + 1700000000
    made = F.when(F.col("log_index") % 4 == 1, F.concat(F.lit('{"seconds":'), at, F.lit(',"nanoseconds":5}'))).when(F.col("log_index") % 4 == 2, at.cast("string"))
    made = made.when(F.col("log_index") % 4 == 3, F.concat(F.lit('"'), F.date_format(F.timestamp_seconds(at), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))).otherwise("null")
    part = F.when(F.col("team_uuid").isNull() | (F.col("log_index") % 5 == 0), ',"LogData":{"note":"none","at":{"x":1}}').when(F.col("log_index") % 5 < 3, F.concat(F.lit(',"challenge_log":{"team_uuid":"'), "team_uuid", F.lit('","kind":"line"}'))).otherwise(F.concat(F.lit(',"LogData":{"note":"n","a":{"team_uuid":"'), "team_uuid", F.lit('"}}')))
    head = F.to_json(F.struct("log_index", "log_type", "game_number", F.col("start_string").alias("start_score_current_game_string"), F.col("end_string").alias("end_score_current_game_string"), "server_uuid", (F.col("log_index") % 2).alias("server_index"), F.col("receiver_uuid").alias("receiver"), F.repeat(F.lit("-"), 60).alias("remark")))
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"date_created":'), F.col("made"), F.col("part"), F.lit("}"))
    sent = log_rows(spark, sf_dir).select("log_index", head.alias("head"), made.alias("made"), part.alias("part")).select("log_index", body.alias("body"))
    return sent.select("log_index", compact_log(F.col("body")).alias("compact"))
