"""Rules, patches, reconciliation and merge queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunker
from ..functions import text as T
from ..operators import review, rules, sync
from ..sources import tables
from .bindings import COURSE_DOCS, course_docs, nth, table
from .registry import query
from .text import CODE_LIST, CORES, listed

ROLES = ("student", "ta", "teacher")
RULES = [(1, "teacher", True), (2, "ta", True), (3, "teacher", False), (4, "student", True), (5, "teacher", True)]
CONDITIONS = [
    (1, "segment", "contains", "BUILDING"), (1, "nation", "not_regex", "^1[0-9]$"), (2, "segment", "regex", "^(AUTO|MACH)"), (3, "segment", "contains", "BUILDING"), (4, "balance", "not_contains", "high"),
]
MEMBER = "([{}])[CAST({} % 3 AS INTEGER) + 1]".format(", ".join(f"'{r}'" for r in ROLES), "{}")


def attributes(spark, d):
    k = F.col("c_custkey")
    each = F.create_map(F.lit("segment"), F.concat_ws(";", F.col("c_mktsegment"), F.lit("ALL")), F.lit("nation"), F.when(k % 4 != 0, F.col("c_nationkey").cast("string")), F.lit("balance"), F.when(F.col("c_acctbal") > 5000, "high").otherwise("low;member"))
    return table(spark, d, "customer").select(k.alias("user_id"), F.explode(each).alias("attribute", "value")).where("value is not null")


FIRED = """fired AS (SELECT c_custkey AS user_id, 1 AS rule_id, 3 AS r FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 <> 0 AND NOT regexp_matches(CAST(c_nationkey AS VARCHAR), '^1[0-9]$')
  UNION ALL SELECT c_custkey, 2, 2 FROM customer WHERE starts_with(c_mktsegment, 'AUTO') OR starts_with(c_mktsegment, 'MACH') UNION ALL SELECT c_custkey, 4, 1 FROM customer WHERE c_acctbal <= 5000)"""


def rule_tables(spark):
    return spark.createDataFrame(RULES, "rule_id long, target_role string, enabled boolean"), spark.createDataFrame(CONDITIONS, "rule_id long, attribute string, operator string, value string")


@query(f"WITH {FIRED} SELECT user_id, CAST(rule_id AS BIGINT) AS rule_id FROM fired")
def p9_rule_predicates(spark, d):
    r, c = rule_tables(spark)
    return rules.fired_rules(r, c, attributes(spark, d)).select("user_id", "rule_id")


@query(f"WITH {FIRED} SELECT user_id, ([{', '.join(repr(r) for r in ROLES)}])[max(r)] AS role FROM fired GROUP BY user_id")
def p10_roles_by_rules(spark, d):
    r, c = rule_tables(spark)
    return rules.roles_by_rules(r, c, attributes(spark, d))


def trees(spark, d):
    k, i = F.get_json_object("props", "$.k"), F.col("event_id") % 7
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    tree = F.when(i == 0, say('{"op":"&","c":[{"type":"date","d":">=","t":', k, "}]}")).when(i == 1, say('{"op":"|","c":[{"type":"date","d":"<","t":', k, '},{"op":"!&","c":[{"type":"date","d":">=","t":10}]}]}'))
    tree = tree.when(i == 2, '{"op":"&","c":[{"type":"group","id":1}]}').when(i == 3, "{").when(i == 4, say('{"op":"!|","c":[{"type":"date","d":"<","t":', k, "}]}")).when(i == 5, '{"op":"&","c":[]}')
    return table(spark, d, "events").select("event_id", tree.alias("tree"), (F.col("event_id") % 2).alias("shown"))


TREE = "CASE event_id % 7 WHEN 0 THEN 50 >= k WHEN 1 THEN 50 < k WHEN 4 THEN NOT 50 < k WHEN 5 THEN true ELSE false END"
K_OF = "(SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"SELECT event_id, {TREE} AS open FROM {K_OF}")
def p11_availability(spark, d):
    return trees(spark, d).select("event_id", rules.permissive(F.col("tree"), 50).alias("open"))


@query(f"SELECT event_id, event_id % 2 = 1 AND (event_id % 7 = 6 OR {TREE}) AS visible FROM {K_OF}")
def p12_visibility(spark, d):
    return trees(spark, d).select("event_id", rules.visible(F.col("shown"), F.col("tree"), 50).alias("visible"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN c_custkey % 3 = 0 ELSE false END AS allowed FROM customer")
def p13_domain_allow_list(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("u"), k.cast("string"), F.when(k % 3 == 0, "@uni.example").otherwise("@mail.example"))
    domains = F.when(k % 4 == 1, F.array().cast("array<string>")).when(k % 4 == 2, F.array(F.lit("UNI.example"), F.lit("x.example"))).when(k % 4 == 3, F.array(F.lit("y.example")))
    return table(spark, d, "customer").select("c_custkey", rules.domain_allowed(name, domains).alias("allowed"))


@query("SELECT o_orderkey, o_orderkey % 5 <> 0 AND CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 2 = 0 ELSE coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END > o_orderkey % 700, false) END AS resync FROM orders")
def p14_needs_resync(spark, d):
    k = F.col("o_orderkey")
    before, latest = F.when(k % 3 != 0, k % 700), F.when(k % 2 == 0, F.col("o_custkey"))
    return table(spark, d, "orders").select("o_orderkey", rules.needs_resync(k % 5 != 0, before, latest).alias("resync"))


@query("SELECT c_custkey, f.flag, CASE WHEN c_custkey % 3 = 0 THEN c_custkey % 2 = 0 WHEN f.flag = 'x' THEN true ELSE false END AS enabled FROM customer, (VALUES ('x'), ('y')) f(flag)")
def p15_scoped_flags(spark, d):
    own = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("flag"))
    scoped = own.where("c_custkey % 3 = 0").withColumn("own", F.col("c_custkey") % 2 == 0)
    everywhere = spark.createDataFrame([("x", True)], "flag string, everywhere boolean")
    return own.join(scoped, ["c_custkey", "flag"], "left").join(everywhere, "flag", "left").select("c_custkey", "flag", rules.resolved_flag(F.col("own"), F.col("everywhere"), False).alias("enabled"))


@query(f"WITH {COURSE_DOCS} SELECT doc_id, kind IS DISTINCT FROM CASE WHEN doc_id % 2 = 0 THEN kind ELSE status END AS changed FROM course_docs")
def p5_null_safe_change(spark, d):
    now = F.when(F.col("doc_id") % 2 == 0, F.col("kind")).otherwise(F.col("status"))
    return course_docs(spark, d).select("doc_id", (~F.col("kind").eqNullSafe(now)).alias("changed"))


@query(f"WITH {COURSE_DOCS} SELECT doc_id FROM course_docs WHERE NOT orphaned AND source_ref IS NOT NULL AND (doc_id // 2) % 3 <> 0")
def p6_set_membership(spark, d):
    """Documents that the source no longer lists (c16 has the same rule with the list as a table)."""
    c = course_docs(spark, d)
    keep = c.where("(doc_id div 2) % 3 = 0").select("source_ref").where("source_ref is not null")
    return sync.vanished(c, keep)


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN 'Name ' || c_custkey END, c_name) AS c_name, CASE WHEN c_custkey % 2 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def p7_partial_update(spark, d):
    base = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    patch = base.where(k % 2 == 0).select("c_custkey", F.when(k % 3 != 0, F.concat(F.lit("Name "), k.cast("string"))).alias("c_name"), F.lit("MOVED").alias("c_mktsegment"))
    return rules.patched(base, patch, "c_custkey")


@query(f"WITH {COURSE_DOCS} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN kind END AS kind, 'pending' AS status FROM course_docs")
def p8_conditional_reset(spark, d):
    return course_docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.col("kind")).alias("kind"), F.lit("pending").alias("status"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey")
def j1_members_with_names(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("SELECT DISTINCT n_nationkey, n_name FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9000 AND c_mktsegment = 'BUILDING' WHERE n_nationkey % 7 = 2 OR c_custkey IS NOT NULL")
def j3_own_or_taught_courses(spark, d):
    """Courses that one owns, or teaches or assists in."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    taught = table(spark, d, "customer").where("c_acctbal > 9000 and c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("taught")).distinct()
    return n.join(taught, "n_nationkey", "left").where("n_nationkey % 7 = 2 or taught").select(F.col("n_nationkey"), "n_name")


@query(
    """SELECT band, c_mktsegment, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, count(DISTINCT n_regionkey) AS regions, min(c_custkey) AS first FROM (SELECT *, CAST(floor(c_acctbal / 20) AS BIGINT) AS band FROM customer) JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey
  GROUP BY ALL HAVING count(DISTINCT n_regionkey) > 1"""
)
def j10_over_scoped(spark, d):
    c = table(spark, d, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 20).cast("long")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    g = c.groupBy("band", "c_mktsegment").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"), F.count_distinct("n_regionkey").alias("regions"), F.min("c_custkey").alias("first"))
    return g.where("regions > 1")


# Documents ------------------------------------------------------------------------------

MERGE = f"""{COURSE_DOCS}, md AS (SELECT *, CASE WHEN doc_id % 7 = 0 THEN doc_id - 7 END AS parent_id, CASE WHEN doc_id % 5 = 0 THEN 'http://x/' || (doc_id // 15) END AS source_url, doc_id % 9 = 0 AS is_link FROM course_docs),
  s AS (SELECT * FROM md WHERE course_id = 'de'), t AS (SELECT * FROM md WHERE course_id = 'en'),
  hit AS (SELECT doc_id FROM s WHERE NOT orphaned AND ((parent_id IS NULL AND content_hash IN (SELECT content_hash FROM t WHERE parent_id IS NULL AND NOT orphaned)) OR EXISTS (SELECT 1 FROM t WHERE NOT t.orphaned AND t.source_ref = s.source_ref AND t.source_system IS NOT DISTINCT FROM s.source_system)
    OR source_url IN (SELECT source_url FROM t WHERE source_url IS NOT NULL)))"""


def merge_docs(spark, d):
    i = F.col("doc_id")
    return course_docs(spark, d).withColumn("parent_id", F.when(i % 7 == 0, i - 7)).withColumn("source_url", F.when(i % 5 == 0, F.concat(F.lit("http://x/"), F.expr("doc_id div 15").cast("string")))).withColumn("is_link", i % 9 == 0)


@query(f"WITH {MERGE} SELECT doc_id FROM hit")
def j14_colliding_documents(spark, d):
    m = merge_docs(spark, d)
    return sync.colliding(m.where("course_id = 'de'"), m.where("course_id = 'en'"))


@query(
    f"""WITH {MERGE}, m AS (SELECT *, orphaned OR doc_id IN (FROM hit) OR coalesce(parent_id IN (FROM hit), false) AS gone FROM s)
  SELECT doc_id, course_id, orphaned, status FROM md WHERE course_id <> 'de' UNION ALL SELECT doc_id, 'en', gone, CASE WHEN NOT gone AND NOT is_link THEN 'pending' ELSE status END FROM m"""
)
def c11_course_merge(spark, d):
    return sync.merged_documents(merge_docs(spark, d), "de", "en").select("doc_id", "course_id", "orphaned", "status")


@query(
    """SELECT user_id, course_id, role FROM (SELECT CASE c_nationkey WHEN 3 THEN 4 ELSE c_nationkey END AS course_id, c_custkey % 20 AS user_id, max(c_custkey % 3) AS r, (['student', 'ta', 'teacher'])[CAST(max(c_custkey % 3) AS INTEGER) + 1] AS role FROM customer GROUP BY 1, 2)"""
)
def a19_merged_members(spark, d):
    m = table(spark, d, "customer").select(F.col("c_nationkey").alias("course_id"), (F.col("c_custkey") % 20).alias("user_id"), nth(ROLES, F.col("c_custkey") % 3).alias("role"))
    return sync.merged_members(m, 3, 4).select("user_id", "course_id", "role")


@query(
    """WITH r AS (SELECT DISTINCT user_id % 10 AS course_id, event_type, json_extract_string(props, '$.k') AS k FROM events) SELECT course_id, event_type, k FROM r WHERE course_id <> 3
  UNION ALL SELECT 4, event_type, k FROM r WHERE course_id = 3 AND (event_type, k) NOT IN (SELECT (event_type, k) FROM r WHERE course_id = 4)"""
)
def j15_move_unless_there(spark, d):
    r = table(spark, d, "events").select((F.col("user_id") % 10).alias("course_id"), "event_type", F.get_json_object("props", "$.k").alias("k")).distinct()
    return sync.move_unless_there(r, 3, 4, ["event_type", "k"])


UPLOADS = f"""{COURSE_DOCS}, live AS (SELECT * FROM course_docs WHERE NOT orphaned), up AS (SELECT doc_id AS upload_id, CASE WHEN doc_id % 9 = 4 THEN 'de' ELSE course_id END AS course_id, CASE doc_id % 7 WHEN 3 THEN 'elsewhere' WHEN 5 THEN NULL ELSE source_system END AS source_system, CASE WHEN doc_id % 4 <> 3 THEN source_ref END AS source_ref,
    CASE doc_id % 4 WHEN 1 THEN sha256('new' || doc_id) WHEN 2 THEN coalesce((SELECT o.content_hash FROM course_docs o WHERE o.doc_id = c.doc_id + 20), 'x') ELSE content_hash END AS content_hash FROM course_docs c),
  ref AS (SELECT course_id, source_system, source_ref, min(doc_id) AS doc_id, arg_min(content_hash, doc_id) AS h FROM live WHERE source_ref IS NOT NULL AND source_system IS NOT NULL GROUP BY 1, 2, 3), hash AS (SELECT course_id, content_hash, min(doc_id) AS doc_id FROM live GROUP BY 1, 2)"""


@query(
    f"""WITH {UPLOADS} SELECT upload_id, CASE WHEN coalesce(r.h = u.content_hash, false) OR h.doc_id IS NOT NULL THEN 'reuse' ELSE 'insert' END AS action, CASE WHEN coalesce(r.h = u.content_hash, false) THEN r.doc_id ELSE h.doc_id END AS doc_id, CASE WHEN r.h <> u.content_hash THEN r.doc_id END AS orphaned_id
  FROM up u LEFT JOIN ref r USING (course_id, source_system, source_ref) LEFT JOIN hash h ON h.course_id = u.course_id AND h.content_hash = u.content_hash"""
)
def c2_upload_dedup(spark, d):
    """Uploads that repeat, edit or move documents: some name another course or system, some have the bytes of another document."""
    c, i = course_docs(spark, d), F.col("doc_id")
    other = c.select((i - 20).alias("doc_id"), F.col("content_hash").alias("other"))
    new = F.when(i % 4 == 1, F.sha2(F.concat(F.lit("new"), i.cast("string")), 256)).when(i % 4 == 2, F.coalesce("other", F.lit("x"))).otherwise(F.col("content_hash"))
    system = F.when(i % 7 == 3, "elsewhere").when(i % 7 != 5, F.col("source_system"))
    up = c.join(other, "doc_id", "left").select(i.alias("upload_id"), F.when(i % 9 == 4, "de").otherwise(F.col("course_id")).alias("course_id"), system.alias("source_system"), F.when(i % 4 != 3, F.col("source_ref")).alias("source_ref"), new.alias("content_hash"))
    return sync.upload_actions(up, c)


@query(f"WITH {COURSE_DOCS} SELECT doc_id FROM course_docs WHERE course_id = 'en' AND NOT orphaned AND source_ref IS NOT NULL AND source_ref NOT IN (SELECT source_ref FROM course_docs WHERE source_ref IS NOT NULL AND doc_id % 4 = 1)")
def c16_source_reconciliation(spark, d):
    c = course_docs(spark, d)
    return sync.vanished(c.where("course_id = 'en'"), c.where("doc_id % 4 = 1 and source_ref is not null"))


@query(f"WITH {COURSE_DOCS} SELECT doc_id, course_id, CASE WHEN course_id = 'en' THEN 2 ELSE 1 END AS version, CASE WHEN course_id = 'en' AND NOT orphaned THEN 'pending' ELSE status END AS status, course_id <> 'en' AS pooled FROM course_docs")
def c12_embedding_rotation(spark, d):
    c = course_docs(spark, d)
    turn = F.col("course_id") == "en"
    return c.select("doc_id", "course_id", F.when(turn, 2).otherwise(1).cast("int").alias("version"), F.when(turn & ~F.col("orphaned"), "pending").otherwise(F.col("status")).alias("status"), (~turn).alias("pooled"))


@query()
def c1_ingest(spark, d):
    """Documents by what becomes of them: chunks, chunks to embed (none of sample solutions), and the status."""
    c = course_docs(spark, d).select("doc_id", "kind")
    n = chunker.chunk_documents(table(spark, d, "documents").select("doc_id", "text")).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    text = table(spark, d, "documents").select("doc_id", (F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"))
    out = c.join(text, "doc_id").join(n, "doc_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    status = F.when(F.col("blank"), "ready").when(F.col("chunks") == 0, "failed").otherwise("ready")
    return out.select("doc_id", "chunks", F.when(F.col("kind") == "sample_solution", 0).otherwise(F.col("chunks")).alias("embedded"), status.alias("status"))


# People ---------------------------------------------------------------------------------

ROSTER = """roster AS (SELECT c_nationkey AS context_id, 'k' || c_custkey AS user_key, CASE WHEN c_custkey % 5 <> 0 AND c_nationkey <> 6 THEN CASE WHEN c_custkey % 7 = 0 THEN 'a' || c_custkey || '@else.example' ELSE 'A' || c_custkey || '@uni.example' END END AS email,
  CASE WHEN c_custkey % 11 = 0 THEN 'Inactive' WHEN c_custkey % 2 = 0 THEN 'Active' END AS status, c_custkey % 13 IN (0, 1, 3) AS teaches, c_custkey FROM customer),
  act AS (SELECT *, email IS NULL AS synthetic, coalesce(lower(email), 'lti_' || user_key) AS name FROM roster WHERE coalesce(status, 'Active') = 'Active'), live AS (SELECT * FROM act WHERE synthetic OR name LIKE '%@uni.example')"""


def rosters(spark, d):
    k = F.col("c_custkey")
    mail = F.when(k % 7 == 0, F.concat(F.lit("a"), k.cast("string"), F.lit("@else.example"))).otherwise(F.concat(F.lit("A"), k.cast("string"), F.lit("@uni.example")))
    role = lambda name: F.lit(f"http://purl.imsglobal.org/vocab/lis/v2/{name}")
    roles = F.when(k % 13 == 0, F.array(role("membership#Learner"), role("membership#Instructor"))).when(k % 13 == 1, F.array(role("institution/person#Faculty"))).when(k % 13 == 2, F.array(role("membership/Instructor#TeachingAssistant")))
    roles = roles.when(k % 13 == 3, F.array(role("system/person#Administrator"))).when(k % 13 == 4, F.array(F.lit("Instructor"))).otherwise(F.array(role("membership#Learner")))
    return table(spark, d, "customer").select(
        F.col("c_nationkey").alias("context_id"), F.concat(F.lit("k"), k.cast("string")).alias("user_key"), F.when((k % 5 != 0) & (F.col("c_nationkey") != 6), mail).alias("email"),
        F.when(k % 11 == 0, "Inactive").when(k % 2 == 0, "Active").alias("status"), roles.alias("roles"), k,
    )


@query(
    f"""WITH {ROSTER}, present AS (SELECT name, CASE WHEN c_custkey % 6 = 0 THEN 'teacher' ELSE 'student' END AS role FROM act WHERE c_custkey % 3 = 0), provided AS (SELECT DISTINCT 'a' || c_custkey || '@uni.example' AS name FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 7 <> 0),
  gone AS (SELECT name FROM provided WHERE name NOT IN (SELECT name FROM live))
  SELECT name, 'add' AS action FROM live WHERE name NOT IN (SELECT name FROM present) UNION SELECT l.name, 'suggest_teacher' FROM live l LEFT JOIN present p USING (name) WHERE l.teaches AND coalesce(p.role, '') <> 'teacher'
  UNION SELECT name, CASE WHEN name LIKE 'a%0@uni.example' THEN 'forget' ELSE 'remove' END FROM gone"""
)
def c9_roster_reconcile(spark, d):
    rows = sync.roster(rosters(spark, d), F.array(F.lit("UNI.example")))
    present = rows.where("c_custkey % 3 = 0").select("name", F.when(F.col("c_custkey") % 6 == 0, "teacher").otherwise("student").alias("role"))
    provided = table(spark, d, "customer").where("c_custkey % 4 = 0 and c_custkey % 7 <> 0").select(F.col("c_nationkey").alias("context_id"), F.concat(F.lit("a"), F.col("c_custkey").cast("string"), F.lit("@uni.example")).alias("name"))
    return sync.roster_actions(rows, present, provided, provided.where("name like 'a%0@uni.example'"))


@query(f"WITH {ROSTER} SELECT context_id, count(*) = count(*) FILTER (WHERE synthetic) AS warn FROM act GROUP BY context_id")
def a23_roster_warning(spark, d):
    return sync.roster_warning(sync.roster(rosters(spark, d), F.array(F.lit("uni.example"))))


IDENT = """part AS (SELECT c_custkey AS participant_id, c_custkey % 5 AS m FROM customer), ident AS (SELECT participant_id, CASE m WHEN 0 THEN participant_id * 10 WHEN 1 THEN participant_id * 10 WHEN 2 THEN participant_id * 10 + 1 WHEN 3 THEN NULL ELSE participant_id * 10 END AS user_id FROM part)"""


def participants(spark, d):
    k = F.col("c_custkey")
    u, a = F.concat(F.lit("u"), k.cast("string")), F.concat(F.lit(" ALIAS"), k.cast("string"))
    names = F.when(k % 5 == 0, F.array(u)).when(k % 5 == 1, F.array(F.lit("nobody"), u)).when(k % 5 == 2, F.array(a, u)).when(k % 5 == 3, F.array(F.lit(" "))).otherwise(F.array(F.upper(u), a))
    p = table(spark, d, "customer").select(k.alias("participant_id"), names.alias("names"))
    users = table(spark, d, "customer").select(u.alias("name"), (k * 10).alias("user_id"))
    aliases = table(spark, d, "customer").select(F.lower(F.trim(a)).alias("name"), (k * 10 + 1).alias("user_id"))
    return p, users, aliases


@query(f"WITH {IDENT} SELECT participant_id, user_id FROM ident")
def j16_identities(spark, d):
    return sync.identities(*participants(spark, d))


@query(
    f"""WITH {IDENT}, r AS (SELECT participant_id, user_id, (['student', 'ta', 'teacher'])[CAST(participant_id % 3 AS INTEGER) + 1] AS role FROM ident WHERE participant_id % 5 <> 3), m AS (SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'ta' ELSE 'teacher' END AS role FROM r WHERE user_id % 3 = 0)
  SELECT participant_id, CASE WHEN m.role IS NULL THEN 'added' ELSE 'role_changed' END AS change, r.role, m.role AS previous_role FROM r LEFT JOIN m USING (user_id) WHERE m.role IS NULL OR m.role <> r.role"""
)
def c10_member_changes(spark, d):
    r = j16_identities(spark, d).where("participant_id % 5 <> 3").withColumn("role", nth(ROLES, F.col("participant_id") % 3))
    m = r.where("user_id % 3 = 0").select("user_id", F.when(F.col("user_id") % 4 == 0, "ta").otherwise("teacher").alias("role"))
    return sync.member_changes(r, m)


@query(
    """SELECT c_custkey, 'name' AS field, c_name AS before, c_name || '!' AS after FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 6 <> 0 UNION ALL SELECT c_custkey, 'segment', c_mktsegment, NULL FROM customer WHERE c_custkey % 5 = 0 AND c_custkey % 6 <> 0"""
)
def c10_field_changes(spark, d):
    k = F.col("c_custkey")
    old = table(spark, d, "customer").where(k % 6 != 0).select(k, F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    new = table(spark, d, "customer").select(k, F.when(k % 4 == 0, F.concat("c_name", F.lit("!"))).otherwise(F.concat(F.lit(" "), "c_name")).alias("name"), F.when(k % 5 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("segment"))
    return sync.field_changes(old, new, "c_custkey", ["name", "segment"])


@query(
    """WITH q AS (SELECT o_orderkey AS query_id, unnest([CAST(o_custkey % 50 AS VARCHAR), CAST(o_custkey % 70 + 100 AS VARCHAR), CAST(o_custkey % 50 AS VARCHAR), 'x']) AS id, unnest([1, 2, 3, 4]) AS pos FROM orders), k AS (SELECT CAST(range AS VARCHAR) AS id, range % 40 AS course_id FROM range(10, 160)),
  h AS (SELECT query_id, id, course_id, min(pos) AS pos FROM q JOIN k USING (id) GROUP BY ALL), f AS (SELECT query_id, arg_min(course_id, pos) AS course_id, count(DISTINCT course_id) > 1 AS multiple FROM h GROUP BY query_id)
  SELECT f.query_id, f.course_id, string_agg(h.id, ',' ORDER BY pos) AS matched, multiple FROM f JOIN h ON h.query_id = f.query_id AND h.course_id = f.course_id GROUP BY ALL"""
)
def j20_first_match(spark, d):
    c = F.col("o_custkey")
    ids = F.array(F.concat(F.lit(" "), (c % 50).cast("string")), (c % 70 + 100).cast("string"), (c % 50).cast("string"), F.lit(""), F.lit("x"))
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query_id"), ids.alias("ids"))
    known = spark.range(10, 160).select(F.col("id").cast("string").alias("id"), (F.col("id") % 40).alias("course_id"))
    return sync.first_match(q, known).withColumn("matched", F.array_join("matched", ","))


@query(
    """SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 <> 1 AND p_partkey % 7 > 1 AND p_size > 5 AND length(p_brand) >= 3 AND p_partkey % 100 IN (SELECT s_suppkey % 100 FROM supplier WHERE s_suppkey % 2 = 0)"""
)
def j17_archive_files(spark, d):
    """Files of visible activities: a module's content area, a real name, a size and a hash."""
    k = F.col("p_partkey")
    files = table(spark, d, "part").select(k, (k % 100).alias("context_id"), F.when(k % 3 == 0, "user").otherwise("mod_page").alias("component"), F.when(k % 4 == 1, "intro").otherwise("content").alias("area"), F.when(k % 7 == 0, "").when(k % 7 == 1, ".").otherwise(F.col("p_name")).alias("name"), (F.col("p_size") - 5).alias("size"), F.col("p_brand").alias("hash"))
    contexts = table(spark, d, "supplier").where("s_suppkey % 2 = 0").select((F.col("s_suppkey") % 100).alias("context_id")).distinct()
    from ..sources.archives import archive_files

    return archive_files(files, contexts).select("p_partkey")


@query(
    """WITH l AS (SELECT 'file' AS kind, p_partkey AS id, p_name AS name, 0 AS p, 'files' AS source FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 <> 0 UNION ALL SELECT CASE WHEN p_partkey % 2 = 0 THEN 'file' ELSE 'page' END, p_partkey, p_brand, 1, 'modules' FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 7 = 0)
  SELECT kind || ':' || id AS key, arg_min(name, p) AS name, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM l GROUP BY 1"""
)
def j18_discovery(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    files = p.where(k % 3 == 0).select(F.lit("file").alias("kind"), k.alias("id"), F.col("p_name").alias("name"), (k % 5 == 0).alias("hidden"))
    modules = p.where((k % 4 == 0) | (k % 7 == 0)).select(F.when(k % 2 == 0, "file").otherwise("page").alias("kind"), k.alias("id"), F.col("p_brand").alias("name"))
    return sync.discovered(files, modules).orderBy(F.lower("name"), "key")


SYNCED = """s AS (SELECT p_partkey, p_partkey % 4 <> 0 AS known, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 20 END AS before, p_size AS latest FROM part),
  o AS (SELECT *, CASE WHEN NOT known THEN 'created' WHEN before IS NULL OR latest > before THEN 'resynced' ELSE 'skipped' END AS outcome FROM s)"""


def synced(spark, d):
    k = F.col("p_partkey")
    s = table(spark, d, "part").select(k, (k % 4 != 0).alias("known"), F.when(k % 3 != 0, k % 20).alias("before"), F.col("p_size").cast("long").alias("latest"))
    return s.withColumn("outcome", F.when(~F.col("known"), "created").when(rules.needs_resync(F.col("known"), F.col("before"), F.col("latest")), "resynced").otherwise("skipped"))


@query(f"WITH {SYNCED} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")
def a22_sync_counters(spark, d):
    return synced(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"WITH {SYNCED} SELECT p_partkey, CASE outcome WHEN 'created' THEN p_partkey * 10 ELSE p_partkey END AS doc_id, CASE outcome WHEN 'skipped' THEN before ELSE latest END AS stamp FROM o")
def c17_source_sync(spark, d):
    """The log after a sync: new documents for what is new; a resync keeps the old document's id, as its news has none."""
    s = synced(spark, d)
    old = s.where("known").select("p_partkey", F.col("p_partkey").alias("doc_id"), F.col("before").alias("stamp"))
    news = s.where("outcome <> 'skipped'").select("p_partkey", F.when(F.col("outcome") == "created", F.col("p_partkey") * 10).alias("doc_id"), F.col("latest").alias("stamp"), F.lit(1).alias("seq"))
    return tables.upsert(old, news, ["p_partkey"], keep_old_if_null=("doc_id",))


@query(
    "WITH n AS (SELECT user_id, event_type, arg_max(value, event_id) AS v FROM events WHERE event_id % 3 = 0 GROUP BY ALL), o AS (SELECT DISTINCT user_id, event_type, 0.5 AS v FROM events WHERE event_id % 3 = 1) SELECT user_id, event_type, round(coalesce(n.v, CAST(o.v AS DOUBLE)), 6) AS v FROM o FULL JOIN n USING (user_id, event_type)"
)
def s12_keyed_upsert(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_id % 3 = 1").select("user_id", "event_type", F.lit(0.5).alias("v")).distinct()
    new = e.where("event_id % 3 = 0").select("user_id", "event_type", F.col("value").alias("v"), F.col("event_id").alias("seq"))
    return tables.upsert(old, new, ["user_id", "event_type"]).withColumn("v", F.round("v", 6))


@query("SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]) AS id, unnest(['a', 'b']) AS name FROM orders")
def s14_zipped_arrays(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.array("o_custkey", F.col("o_custkey") + 1).alias("id"), F.array(F.lit("a"), F.lit("b")).alias("name"))
    return tables.zipped(rows, "id", "name")


@query(
    f"""WITH c AS (SELECT o_orderkey AS course_id, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderpriority END AS semester, 'K' || o_custkey || ' ' || {listed(CODE_LIST, 'o_orderkey')} AS code, nullif('K' || o_custkey || '-' || {listed(tuple('' if c is None else 'AB' if c == 'S-AB' else c for c in CORES), 'o_orderkey')}, '') AS raw, o_orderkey % 3 AS name FROM orders),
  k AS (SELECT *, regexp_replace(CASE WHEN code LIKE '%S-AB' THEN 'K' || split_part(substring(code, 2), ' ', 1) ELSE raw END, '-$', '') AS core FROM c)
  SELECT semester, core, string_agg(CAST(course_id AS VARCHAR), ',' ORDER BY encode(code), name, course_id) AS members, count(*) AS n FROM k GROUP BY semester, core HAVING count(*) >= 2"""
)
def a24_merge_suggestions(spark, d):
    """Courses of all orders; a code holds its customer, so groups stay small however many there are."""
    k = F.col("o_orderkey")
    c = table(spark, d, "orders").select(k.alias("course_id"), F.when(k % 10 != 0, F.col("o_orderpriority")).alias("semester"), F.concat(F.lit("K"), F.col("o_custkey").cast("string"), F.lit(" "), nth(CODE_LIST, k % len(CODE_LIST))).alias("code"), (k % 3).alias("name"))
    m = sync.merge_suggestions(c.withColumn("core", T.course_code(F.col("code"))))
    return m.select("semester", "core", F.array_join(F.transform("members", lambda x: x.cast("string")), ",").alias("members"), "n").orderBy(F.desc("n"), "core")


@query(
    f"""WITH {COURSE_DOCS}, last AS (SELECT course_id, array_to_string(list(doc_id ORDER BY r), ',') AS now FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY n_chars DESC, doc_id DESC) AS r FROM course_docs WHERE status = 'ready') WHERE r <= 3 GROUP BY course_id),
  c AS (SELECT DISTINCT course_id, strlen(course_id) > 2 AS odd, course_id < 'en' AS young, course_id = 'en' AS same FROM course_docs) SELECT course_id, CASE WHEN young THEN 'keep' WHEN same THEN 'touch' ELSE 'make' END AS state FROM c
  UNION ALL SELECT course_id || '-unasked', 'make' FROM c UNION ALL SELECT course_id || '-empty', 'touch' FROM c UNION ALL SELECT course_id || '-emptied', 'make' FROM c"""
)
def c18_suggested_questions(spark, d):
    docs = course_docs(spark, d).withColumn("created", F.col("n_chars"))
    top = review.top_by(docs.where("status = 'ready' and course_id = 'en'"), ["course_id"], [F.desc("n_chars"), F.desc("doc_id")], 3)
    seen = top.groupBy("course_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]).alias("seen"))
    courses = docs.select("course_id").distinct().withColumn("age_hours", F.when(F.col("course_id") < "en", 23.5).otherwise(30.0)).join(seen, "course_id", "left")
    none = lambda name, age, ids: courses.select(F.concat("course_id", F.lit(name)).alias("course_id"), F.lit(age).cast("double").alias("age_hours"), ids.cast("array<long>").alias("seen"))
    more = none("-unasked", None, F.lit(None)).unionByName(none("-empty", 30.0, F.array())).unionByName(none("-emptied", 30.0, F.array(F.lit(1))))
    return sync.suggestion_state(courses.unionByName(more), docs)


@query(f"WITH {COURSE_DOCS} SELECT doc_id, filename FROM course_docs WHERE course_id = 'en' ORDER BY n_chars DESC, doc_id")
def s1_scan_by_key(spark, d):
    return course_docs(spark, d).where("course_id = 'en'").orderBy(F.desc("n_chars"), "doc_id").select("doc_id", "filename")


@query(f"WITH {COURSE_DOCS} SELECT course_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY doc_id) AS r FROM course_docs) WHERE r <= 300")
def k10_course_cap(spark, d):
    return review.top_by(course_docs(spark, d).select("course_id", "doc_id"), ["course_id"], ["doc_id"], 300).select("course_id", "doc_id")


