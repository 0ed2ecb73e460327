"""Reconciling what is kept with what a source says now: documents, rosters, offerings and merged courses.

Each function takes the old rows and the news and returns new rows or actions; nothing is
changed in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rules import domain_allowed, higher_role


def colliding(source: DataFrame, target: DataFrame) -> DataFrame:
    """(doc_id): active documents of a source course that the target has by hash (top-level ones), by reference and system (null equals null), or by url. Three semi-joins, so none needs an OR."""
    s = source.where("not orphaned")
    top = lambda df: df.where("parent_id is null and content_hash is not null")
    live = target.where("not orphaned")
    by_hash = top(s).join(top(live).select("content_hash"), "content_hash", "left_semi").select("doc_id")
    ref = live.where("source_ref is not null").select(F.col("source_ref").alias("_r"), F.col("source_system").alias("_s"))
    by_ref = s.join(ref, (F.col("source_ref") == F.col("_r")) & F.col("source_system").eqNullSafe(F.col("_s")), "left_semi").select("doc_id")
    by_url = s.join(target.where("source_url is not null").select("source_url"), "source_url", "left_semi").select("doc_id")
    return by_hash.unionByName(by_ref).unionByName(by_url).distinct()


def merged_documents(docs: DataFrame, source: str, target: str) -> DataFrame:
    """Documents after one course is merged into another: collisions and their children become orphans and lose their address, all move, and live ones that aren't links wait to be read anew, without a pooled vector (column `pooled`)."""
    s, t = docs.where(F.col("course_id") == source), docs.where(F.col("course_id") == target)
    hit = colliding(s, t)
    gone = hit.unionByName(s.join(hit.select(F.col("doc_id").alias("parent_id")), "parent_id", "left_semi").select("doc_id")).distinct().withColumn("_gone", F.lit(True))
    moved = s.join(gone, "doc_id", "left").withColumn("source_url", F.when(F.col("orphaned") | F.col("_gone").isNull(), F.col("source_url")))
    moved = moved.withColumn("orphaned", F.col("orphaned") | F.coalesce("_gone", F.lit(False))).drop("_gone").withColumn("course_id", F.lit(target))
    moved = moved.withColumn("status", F.when(~F.col("orphaned") & ~F.col("is_link"), "pending").otherwise(F.col("status")))
    if "pooled" in docs.columns:
        moved = moved.withColumn("pooled", F.when(F.col("orphaned") | F.col("is_link"), F.col("pooled")))
    return docs.where(F.col("course_id").isNull() | (F.col("course_id") != source)).unionByName(moved.select(*docs.columns))


def merge_course(t, source: str, target: str) -> None:
    """One course merged into another, in a store's transaction with the tables documents, members(course_id, user_id, role), ledger(course_id, day, tokens), config(course_id, name) and courses(course_id, state).

    Documents as in merged_documents(); members keep the higher role; tokens are added day by
    day; names that the target has not move, the rest go; the source is marked as merged. Only
    rows of the two courses are written, and only when the transaction is committed.
    """
    docs = t.read("documents")
    moving = docs.where(F.col("course_id") == source).select(F.col("doc_id").alias("_id"))
    t.upsert("documents", merged_documents(docs.where(F.col("course_id").isin(source, target)), source, target).join(moving, F.col("doc_id") == F.col("_id"), "left_semi"))
    members = t.read("members").where(F.col("course_id").isin(source, target))
    t.upsert("members", merged_members(members, source, target))
    ledger = t.read("ledger").where(F.col("course_id") == source)
    t.upsert("ledger", ledger.withColumn("course_id", F.lit(target)), add=("tokens",))
    config = t.read("config").where(F.col("course_id").isin(source, target))
    t.upsert("config", move_unless_there(config, source, target, ["name"]))
    for name in ("members", "ledger", "config"):
        t.delete(name, t.read(name).where(F.col("course_id") == source))
    t.upsert("courses", t.spark.createDataFrame([(source, "merged")], "course_id string, state string"))


def move_unless_there(rows: DataFrame, source, target, keys: list, course: str = "course_id") -> DataFrame:
    """Rows of the source course join the target's, but for keys that the target has; these go."""
    there = rows.where(F.col(course) == target)
    moved = rows.where(F.col(course) == source).join(there.select(*keys), keys, "left_anti").withColumn(course, F.lit(target).cast(rows.schema[course].dataType))
    return rows.where(F.col(course) != source).unionByName(moved.select(*rows.columns))


def merged_members(members: DataFrame, source, target) -> DataFrame:
    """Members of two courses in the target, each with the higher role."""
    kind = members.schema["course_id"].dataType
    both = members.withColumn("course_id", F.when(F.col("course_id") == source, F.lit(target).cast(kind)).otherwise(F.col("course_id")))
    return higher_role(both, both.limit(0))


def upload_actions(uploads: DataFrame, docs: DataFrame) -> DataFrame:
    """uploads(upload_id, course_id, source_system, source_ref, content_hash) -> (upload_id, action, doc_id, orphaned_id).

    A document of the course with the system, the reference and the hash is reused. One with
    another hash becomes an orphan; then an active document of the course with the hash is
    reused, else one is inserted (doc_id null). A null system or reference finds nothing; of
    several documents the smallest id counts.
    """
    live, source = docs.where("not orphaned"), ["course_id", "source_system", "source_ref"]
    by_ref = live.where("source_system is not null and source_ref is not null").groupBy(*source).agg(F.min(F.struct("doc_id", "content_hash")).alias("r"))
    by_hash = live.groupBy("course_id", "content_hash").agg(F.min("doc_id").alias("h"))
    u = uploads.join(by_ref, source, "left").join(by_hash, ["course_id", "content_hash"], "left")
    same = F.coalesce(F.col("r.content_hash") == F.col("content_hash"), F.lit(False))
    action = F.when(same | F.col("h").isNotNull(), "reuse").otherwise("insert")
    return u.select("upload_id", action.alias("action"), F.when(same, F.col("r.doc_id")).otherwise(F.col("h")).alias("doc_id"), F.when(~same, F.col("r.doc_id")).alias("orphaned_id"))


def vanished(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """(doc_id): active documents whose reference the source no longer lists. A document without a reference isn't the source's."""
    return docs.where("not orphaned and source_ref is not null").join(keep.select("source_ref").distinct(), "source_ref", "left_anti").select("doc_id")


def roster(members: DataFrame, domains) -> DataFrame:
    """members(context_id, user_key, email, status, roles) -> active rows with the key they count by, and whether it is synthetic; claimed keys outside the allowed domains are refused."""
    active = members.where(F.coalesce("status", F.lit("Active")) == "Active")
    claimed = F.nullif(F.lower(F.trim("email")), F.lit(""))
    rows = active.withColumn("synthetic", claimed.isNull()).withColumn("name", F.coalesce(claimed, F.concat(F.lit("lti_"), F.col("user_key"))))
    return rows.withColumn("refused", ~F.col("synthetic") & ~domain_allowed(F.col("name"), domains))


#: Role names that make a teacher, wherever they are in a role.
TEACHER_ROLES = (
    "http://purl.imsglobal.org/vocab/lis/v2/membership#Instructor",
    "http://purl.imsglobal.org/vocab/lis/v2/institution/person#Instructor",
    "http://purl.imsglobal.org/vocab/lis/v2/membership#ContentDeveloper",
    "http://purl.imsglobal.org/vocab/lis/v2/institution/person#Faculty",
    "http://purl.imsglobal.org/vocab/lis/v2/system/person#Administrator",
    "http://purl.imsglobal.org/vocab/lis/v2/institution/person#Administrator",
    "http://purl.imsglobal.org/vocab/lis/v2/membership#Administrator",
)


def teaches(role: Column) -> Column:
    return F.greatest(*(role.contains(r) for r in TEACHER_ROLES))


def roster_actions(rows: DataFrame, present: DataFrame, provided: DataFrame, owners: DataFrame) -> DataFrame:
    """rows: roster(); present(name, role): members of the course; provided(context_id, name): who came by which context; owners(name) -> (name, action), one context at a time or many.

    add, suggest_teacher; for those that a context no longer lists: forget for owners and
    those that another context still lists, remove for others.
    """
    live = rows.where("not refused").groupBy("context_id", "name").agg(F.max(F.exists("roles", teaches)).alias("teaches"))
    have = present.select("name", "role")
    known = live.join(have, "name", "left")
    add = known.where("role is null").select("name", F.lit("add").alias("action"))
    suggest = known.where("teaches and (role is null or role <> 'teacher')").select("name", F.lit("suggest_teacher").alias("action"))
    gone = provided.join(live.select("context_id", "name"), ["context_id", "name"], "left_anti").select("name").distinct()
    keep = owners.select("name").unionByName(live.select("name")).distinct().withColumn("_keep", F.lit(True))
    left = gone.join(keep, "name", "left").select("name", F.when(F.col("_keep"), "forget").otherwise("remove").alias("action"))
    return add.unionByName(suggest).unionByName(left).distinct()


def roster_warning(rows: DataFrame) -> DataFrame:
    """(context_id, warn): no active member of a context could be told by name."""
    return rows.groupBy("context_id").agg((F.count("*") == F.count_if("synthetic")).alias("warn"))


def identities(participants: DataFrame, users: DataFrame, aliases: DataFrame) -> DataFrame:
    """participants(participant_id, names) -> (participant_id, user_id): the user of the first name that is a user's own or an alias; own names go before aliases. Null if none is."""
    names = participants.select("participant_id", F.posexplode("names").alias("pos", "name")).withColumn("name", F.lower(F.trim("name"))).where("name <> ''")
    known = users.select(F.lower("name").alias("name"), "user_id", F.lit(0).alias("via")).unionByName(aliases.select(F.lower("name").alias("name"), "user_id", F.lit(1).alias("via")))
    hit = names.join(known, "name").groupBy("participant_id").agg(F.min(F.struct("pos", "via", "user_id")).alias("m"))
    return participants.select("participant_id").join(hit, "participant_id", "left").select("participant_id", F.col("m.user_id").alias("user_id"))


def field_changes(old: DataFrame, new: DataFrame, key: str, fields: list) -> DataFrame:
    """(key, field, before, after): fields that differ once trimmed, empty counting as null; keys that old lacks have none."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    o = old.select(key, *[clean(c).alias(f"_{c}") for c in fields])
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"_{c}").alias("before"), clean(c).alias("after")) for c in fields])
    return new.join(o, key).select(key, F.explode(each).alias("f")).select(key, "f.*").where("not (before <=> after)")


def member_changes(resolved: DataFrame, members: DataFrame) -> DataFrame:
    """resolved(participant_id, user_id, role) -> (participant_id, change, role, previous_role): added or role_changed; those who stay as they are have no row."""
    m = members.select("user_id", F.col("role").alias("previous_role"))
    out = resolved.join(m, "user_id", "left").where("previous_role is null or previous_role <> role")
    return out.select("participant_id", F.when(F.col("previous_role").isNull(), "added").otherwise("role_changed").alias("change"), "role", "previous_role")


def first_match(queries: DataFrame, known: DataFrame) -> DataFrame:
    """queries(query_id, ids), known(id, course_id) -> (query_id, course_id, matched, multiple): the course of the first id that resolves; the ids of it, in order; whether ids lead to more than one course."""
    each = queries.select("query_id", F.posexplode(F.array_distinct(F.filter(F.transform("ids", lambda x: F.trim(x)), lambda x: x != ""))).alias("pos", "id")).join(known, "id")
    got = each.groupBy("query_id").agg(F.min_by("course_id", "pos").alias("course_id"), F.array_sort(F.collect_list(F.struct("pos", "id", "course_id"))).alias("m"), (F.count_distinct("course_id") > 1).alias("multiple"))
    mine = F.filter("m", lambda x: x["course_id"] == F.col("course_id"))
    return got.select("query_id", "course_id", F.transform(mine, lambda x: x["id"]).alias("matched"), "multiple")


def discovered(files: DataFrame, modules: DataFrame) -> DataFrame:
    """files(kind, id, name, hidden), modules(kind, id, name) -> (key, name, sources): one row per kind and id; the files listing decides on names, hidden ones are dropped from it alone."""
    f = files.where("not hidden").select("kind", "id", "name", F.lit(0).alias("p"), F.lit("files").alias("source"))
    m = modules.select("kind", "id", "name", F.lit(1).alias("p"), F.lit("modules").alias("source"))
    key = F.concat_ws(":", "kind", F.col("id").cast("string"))
    return f.unionByName(m).groupBy(key.alias("key")).agg(F.min_by("name", F.struct("p", "name")).alias("name"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


def merge_suggestions(courses: DataFrame) -> DataFrame:
    """courses(course_id, semester, core, code, name) -> (semester, core, members, n): courses of one semester and core of the code, two at least, by code, then name; a null semester is one too."""
    # Rows that have no other are most of all; they are left out before lists are made.
    n = F.count("*").over(Window.partitionBy("semester", "core"))
    rows = courses.where("core is not null").select("semester", "core", "code", "name", "course_id", n.alias("n")).where("n >= 2")
    rows = rows.groupBy("semester", "core").agg(F.sort_array(F.collect_list(F.struct("code", "name", "course_id"))).alias("m"), F.count("*").alias("n"))
    return rows.select("semester", "core", F.col("m.course_id").alias("members"), "n")


def suggestion_state(courses: DataFrame, docs: DataFrame, latest: int = 3, stale_after: float = 24.0) -> DataFrame:
    """courses(course_id, age_hours, seen): what to do with each course's suggested questions: keep young ones, touch old ones whose latest documents are the same (none counts as the same as none), else make them anew, as where there are no questions yet (a null age)."""
    w = Window.partitionBy("course_id").orderBy(F.desc("created"), F.desc("doc_id"))
    last = docs.where("status = 'ready'").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= latest)
    ids = last.groupBy("course_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "doc_id"))), lambda x: x["doc_id"]).alias("now"))
    out = courses.join(ids, "course_id", "left")
    state = F.when(F.col("age_hours") < stale_after, "keep").when(F.col("age_hours").isNotNull() & (F.coalesce("now", F.array()) == F.coalesce("seen", F.array())), "touch").otherwise("make")
    return out.select("course_id", state.alias("state"))
