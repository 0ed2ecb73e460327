"""Text, JSON and topic queries."""

from __future__ import annotations

import html
import io
import tarfile

from pyspark.sql import functions as F

from ..functions import chunker
from ..functions import text as T
from ..operators import retrieval, topics
from ..operators.durable import shared_path
from ..sources import archives, text_index
from ..sources import text as sources
from .bindings import COURSE_DOCS, KINDS, course_docs, nth, table
from .registry import query

GAP = "[^\\p{L}\\p{N}'']+"
TOK = f"""tok AS (SELECT conv_id, turn, list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '{GAP}'), lambda w: strlen(w) > 2), lambda w: trim(w, '''')), lambda w: strlen(w) > 2) AS t FROM conversations WHERE role = 'user')"""
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TERMS = f"""{TOK}, two AS (SELECT conv_id, unnest(list_transform(range(1, greatest(len(t), 1)), lambda i: [t[i], t[i + 1]])) AS p FROM tok),
  terms AS (SELECT DISTINCT conv_id, term FROM (SELECT conv_id, unnest(t) AS term FROM tok) WHERE NOT list_contains({STOP}, term) UNION SELECT DISTINCT conv_id, p[1] || ' ' || p[2] FROM two WHERE NOT list_has_any({STOP}, p))"""


def users(spark, d):
    return table(spark, d, "conversations").where("role = 'user'")


@query(f"WITH {TOK} SELECT conv_id, turn, len(t) AS n, coalesce(array_to_string(t[1:8], ' '), '') AS head FROM tok")
def t6_topic_tokens(spark, d):
    t = users(spark, d).select("conv_id", "turn", T.topic_tokens(F.col("text")).alias("t"))
    return t.select("conv_id", "turn", F.size("t").cast("long").alias("n"), F.array_join(F.slice("t", 1, 8), " ").alias("head"))


@query(f"WITH {TERMS} SELECT term, count(*) AS n FROM terms GROUP BY term HAVING count(*) >= 2")
def t7_topic_candidates(spark, d):
    return topics.candidates(topics.terms(users(spark, d)))


#: Topics picked one after the other, with the conversations that have been picked so far.
PICKED = f"""WITH RECURSIVE {TERMS}, cand AS MATERIALIZED (SELECT term, count(*) AS n, list(conv_id ORDER BY conv_id) AS convs FROM terms GROUP BY term HAVING count(*) >= 2),
  f AS (SELECT CAST(0 AS BIGINT) AS place, '' AS term, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS convs, CAST([] AS BIGINT[]) AS taken
    UNION ALL SELECT place + 1, b.term, b.n, b.convs, list_concat(taken, b.convs) FROM (SELECT f.place, f.taken, arg_min(c, (CASE WHEN instr(c.term, ' ') > 0 THEN 0 ELSE 1 END, -c.n, c.term)) AS b FROM f JOIN cand c ON len(list_filter(c.convs, lambda x: NOT list_contains(f.taken, x))) >= 2 WHERE f.place < 15 GROUP BY f.place, f.taken))"""


@query(f"{PICKED} SELECT place, term, n FROM f WHERE place > 0")
def a21_popular_topics(spark, d):
    return topics.popular(users(spark, d))


@query(f"{PICKED} SELECT place, term, unnest(convs) AS conv_id FROM f WHERE place > 0")
def a21_topic_conversations(spark, d):
    return topics.topic_conversations(topics.popular(users(spark, d)), users(spark, d))


@query(
    f"""{PICKED}, m AS (SELECT conv_id, conv_id % 37 AS user_id, count(*) AS messages FROM conversations GROUP BY 1)
  SELECT place, term, count(*) AS conversations, count(DISTINCT user_id) AS unique_users, CAST(sum(messages) AS BIGINT) AS total_messages FROM (SELECT place, term, unnest(convs) AS conv_id FROM f WHERE place > 0) JOIN m USING (conv_id) GROUP BY ALL"""
)
def a21_topic_overview(spark, d):
    """Topics with their conversations, users and messages; a user has every 37th conversation."""
    about = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("messages")).withColumn("user_id", F.col("conv_id") % 37)
    return topics.topic_overview(topics.topic_conversations(topics.popular(users(spark, d)), users(spark, d)), about)


@query(f"WITH {COURSE_DOCS} SELECT doc_id, lower(coalesce(nullif(regexp_extract(filename, '\\.([^./\\\\]+)$', 1), ''), 'bin')) AS ext FROM course_docs")
def s5_extension(spark, d):
    return course_docs(spark, d).select("doc_id", T.extension(F.col("filename")).alias("ext"))


@query(f"WITH {COURSE_DOCS} SELECT filename, lower(coalesce(nullif(regexp_extract(filename, '\\.([^./\\\\]+)$', 1), ''), 'bin')) IN ('txt', 'md', 'rst', 'csv', 'tsv') AS supported FROM course_docs")
def s2_supported_types(spark, d):
    return course_docs(spark, d).select("filename", T.extension(F.col("filename")).isin(*sources.PLAIN).alias("supported"))


@query("SELECT count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters, count(DISTINCT line) AS different FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)")
def s2_text_files(spark, d):
    """The documents written as .txt files, beside files that are no plain text, and read back."""
    path = shared_path(spark, "texts")
    table(spark, d, "documents").select("text").write.text(f"{path}/plain")
    table(spark, d, "nation").select("n_name").write.option("compression", "gzip").text(f"{path}/other")
    line = sources.text_files(spark, path).select(F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return line.agg(F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"), F.count_distinct("line").alias("different"))


@query()
def s3_html_text(spark, d):
    return sources.html_pages(table(spark, d, "pages"))


@query()
def t1_chunks(spark, d):
    return chunker.chunk_documents(table(spark, d, "documents").select("doc_id", "text"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT doc_id, trim(line, ' ' || chr(9) || chr(13)) AS t FROM l WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND strlen(trim(line, ' ' || chr(9) || chr(13))) < 80 GROUP BY ALL HAVING count(*) >= 3)
  SELECT doc_id, count(*) AS boilerplate FROM b GROUP BY doc_id"""
)
def t2_boilerplate_lines(spark, d):
    line = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.expr("trim(BOTH ' \t\r' FROM line)").alias("t"))
    short = line.where((F.col("t") != "") & (F.octet_length("t") < chunker.LINE)).groupBy("doc_id", "t").agg(F.count("*").alias("n"))
    return short.where(F.col("n") >= chunker.REPEATS).groupBy("doc_id").agg(F.count("*").alias("boilerplate"))


LINES = "list_transform(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda x: regexp_replace(x, '\\r$', ''))"


@query(
    f"""WITH l AS (SELECT doc_id, {LINES} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM l), t AS (SELECT *, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS t FROM e),
  n AS (SELECT *, count(*) OVER (PARTITION BY doc_id, t) AS n FROM t) SELECT doc_id, sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (WHERE t = '' OR n < 3 OR strlen(t) >= 80), '')) AS text_hash FROM n GROUP BY doc_id"""
)
def t2_clean_text(spark, d):
    c = chunker.cleaned_documents(table(spark, d, "documents").select("doc_id", "text"))
    return c.select("doc_id", F.sha2("text", 256).alias("text_hash"))


@query("SELECT page_id, len(list_filter(list_transform(string_split(html, '</p>'), lambda p: trim(p, ' ' || chr(10))), lambda p: p <> '')) AS n FROM pages")
def t3_html_paragraphs(spark, d):
    parts = F.filter(F.transform(F.split("html", "</p>"), lambda p: F.btrim(p, F.lit(" \n"))), lambda p: p != "")
    return table(spark, d, "pages").select("page_id", F.size(parts).cast("long").alias("n"))


SPREAD = "replace(replace(text, '. ', chr(10) || chr(10) || ' '), ', ', chr(10) || chr(10) || chr(10))"


@query(f"SELECT doc_id, len(p) AS n, sha256(array_to_string(p, '|')) AS hash FROM (SELECT doc_id, list_filter(list_transform(string_split({SPREAD}, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM documents)")
def t3_paragraphs(spark, d):
    """Paragraphs of the documents with blank lines in place of marks: two line breaks for one mark, three for another."""
    text = F.replace(F.replace("text", F.lit(". "), F.lit("\n\n ")), F.lit(", "), F.lit("\n\n\n"))
    p = table(spark, d, "documents").select("doc_id", T.paragraphs(text).alias("p"))
    return p.select("doc_id", F.size("p").cast("long").alias("n"), F.sha2(F.array_join("p", "|"), 256).alias("hash"))


@query("SELECT doc_id, sha256(text) AS content_hash, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents")
def t5_content_hash(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return h.join(h.groupBy("content_hash").agg(F.count("*").alias("copies")), "content_hash").select("doc_id", "content_hash", "copies")


FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
INDEX = "list_distinct(list_filter(regexp_split_to_array(" + FOLD + ", '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 2 AND length(w) <= {}))"


@query(f"SELECT doc_id, len({INDEX.format('text', 20)}) AS n, coalesce(array_to_string(list_sort({INDEX.format('text', 20)})[1:5], ' '), '') AS first FROM documents")
def t8_index_tokens(spark, d):
    t = table(spark, d, "documents").select("doc_id", T.index_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n"), F.array_join(F.slice(F.array_sort("t"), 1, 5), " ").alias("first"))


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {INDEX.format("array_to_string(string_split(text, ' ')[1:3], ' ')", 20)} AS t FROM benchmark), d AS (SELECT doc_id AS chunk_id, {INDEX.format('text', 20)} AS body, {INDEX.format("source || ' ' || lang", 40)} AS name FROM documents WHERE doc_id % 17 <> 0)
  SELECT query_id, chunk_id FROM q JOIN d ON len(t) > 0 AND (list_has_all(body, t) OR list_has_all(name, t))"""
)
def t9_keyword_match(spark, d):
    return retrieval.keyword_matches(*keyword_tables(spark, d))


def keyword_tables(spark, d):
    """The first three words of each benchmark item, and documents without orphans, as tokens."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.index_tokens(F.array_join(F.slice(F.split("text", " "), 1, 3), " ")).alias("tokens"))
    docs = table(spark, d, "documents").where("doc_id % 17 <> 0")
    c = docs.select(F.col("doc_id").alias("chunk_id"), T.index_tokens(F.col("text")).alias("body"), T.index_tokens(F.concat_ws(" ", "source", "lang"), 40).alias("name"))
    return q, c


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {INDEX.format("array_to_string(string_split(text, ' ')[1:3], ' ')", 20)} AS t FROM benchmark), d AS (SELECT doc_id AS chunk_id, {INDEX.format('text', 20)} AS body, {INDEX.format("source || ' ' || lang", 40)} AS name FROM documents WHERE doc_id % 17 <> 0)
  SELECT query_id, chunk_id FROM q JOIN d ON len(t) > 0 AND (list_has_all(body, t) OR list_has_all(name, t))"""
)
def t9_indexed_match(spark, d):
    """Keyword search through an index that is written once and read by buckets and blocks."""
    q, c = keyword_tables(spark, d)
    path = shared_path(spark, "text-index")
    text_index.write_index(c, path)
    return text_index.search(q, text_index.read_index(spark, path))


@query(f"""WITH w AS (SELECT unnest({INDEX.format('text', 20)}) AS token FROM documents WHERE doc_id % 17 <> 0) SELECT token, count(*) AS chunks, count(*) AS occurrences FROM w GROUP BY token""")
def t8_index_frequencies(spark, d):
    """How many chunks each token of the index has in its body; tokens of a chunk are distinct."""
    path = shared_path(spark, "text-index")
    text_index.write_index(keyword_tables(spark, d)[1], path)
    return text_index.frequencies(text_index.read_index(spark, path)).where("part = 'body'").select("token", "chunks", "occurrences")


@query("SELECT conv_id, turn, CASE WHEN conv_id % 3 = 1 THEN 'query: ' || text ELSE text END AS query FROM conversations WHERE role = 'user'")
def t11_query_prefix(spark, d):
    return users(spark, d).select("conv_id", "turn", T.prefixed_query(F.col("text"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")), ("m1",)).alias("query"))


@query("SELECT doc_id, sha256(CASE WHEN length(text) <= 10000 THEN text ELSE left(text, 8500) || chr(10) || chr(10) || '[… ' || (length(text) - 10000) || ' characters omitted …]' || chr(10) || chr(10) || right(text, 1500) END) AS excerpt_hash FROM documents")
def t12_excerpt(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(T.excerpt(F.col("text")), 256).alias("excerpt_hash"))


@query(
    "SELECT conv_id AS doc_id, left(string_agg(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')), ' ' ORDER BY turn), 1500) AS excerpt FROM conversations WHERE turn < 5 GROUP BY conv_id"
)
def t13_linker_excerpt(spark, d):
    return retrieval.linker_excerpt(table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), "text"))


@query("SELECT source, doc_id, left(text, 600) AS head FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS r FROM documents) WHERE r <= 3")
def t14_heads_of_latest(spark, d):
    from ..operators.review import top_by

    last = top_by(table(spark, d, "documents").select("source", "doc_id"), ["source"], [F.desc("doc_id")], 3)
    text = table(spark, d, "documents").select("doc_id", F.substring("text", 1, 600).alias("head"))
    return last.join(text, "doc_id").select("source", "doc_id", "head")


NTH = f"([{', '.join(repr(k) for k in KINDS)}])[CAST(doc_id % 10 AS INTEGER) + 1]"
REPLIES = f"""replies AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '```json' || chr(10) || '{{"kind": "' || {NTH} || '", "confidence": ' || doc_id % 3 || '.5}}' || chr(10) || '```' WHEN 1 THEN ' {{"kind": "' || {NTH} || '", "confidence": 0.25}}'
  WHEN 2 THEN '{{"kind": "poem", "confidence": 0.5}}' WHEN 3 THEN '{{"kind": "' || {NTH} || '"}}' ELSE CASE WHEN doc_id % 10 = 9 THEN '{{"kind": "exam", "confidence": 0.5}} Hope that helps!' ELSE 'I think it is a lecture.' END END AS raw FROM documents)"""
BARE = "trim(regexp_replace(raw, '^\\s*```(?:json)?\\s*|\\s*```\\s*$|^\\s+|\\s+$', '', 'g'))"


def replies(spark, d):
    i, kind = F.col("doc_id"), nth(KINDS, F.col("doc_id") % 10)
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    raw = F.when(i % 5 == 0, say('```json\n{"kind": "', kind, '", "confidence": ', (i % 3).cast("string"), ".5}\n```")).when(i % 5 == 1, say(' {"kind": "', kind, '", "confidence": 0.25}'))
    raw = raw.when(i % 5 == 2, '{"kind": "poem", "confidence": 0.5}').when(i % 5 == 3, say('{"kind": "', kind, '"}')).when(i % 10 == 9, '{"kind": "exam", "confidence": 0.5} Hope that helps!').otherwise("I think it is a lecture.")
    return table(spark, d, "documents").select("doc_id", raw.alias("raw"))


@query(
    f"""WITH {REPLIES}, p AS (SELECT doc_id, CASE WHEN json_valid({BARE}) THEN json_extract_string({BARE}, '$.kind') END AS k, CASE WHEN json_valid({BARE}) THEN CAST(json_extract_string({BARE}, '$.confidence') AS DOUBLE) END AS c FROM replies)
  SELECT doc_id, CASE WHEN k IN {KINDS} AND c IS NOT NULL THEN k END AS kind, CASE WHEN k IN {KINDS} AND c IS NOT NULL THEN greatest(0, least(1, c)) END AS confidence FROM p"""
)
def t15_verdicts(spark, d):
    v = replies(spark, d).select("doc_id", T.verdict(F.col("raw"), KINDS).alias("v"))
    return v.select("doc_id", "v.kind", "v.confidence")


@query("SELECT conv_id, turn, lower(regexp_replace(s, '^[^\\p{L}]+|[^\\p{L}]+$', '', 'g')) = 'yes' AS yes FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN ' **Yes**. ' WHEN 1 THEN 'yes and no' ELSE text END AS s FROM conversations)")
def t16_yes(spark, d):
    s = F.when(F.col("turn") % 3 == 0, " **Yes**. ").when(F.col("turn") % 3 == 1, "yes and no").otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.yes(s).alias("yes"))


LAST = "regexp_replace(string_split(regexp_replace({0}, '\\n$', ''), chr(10))[-1], '^\\s+|\\s+$', '', 'g')"
ROW = "(starts_with({0}, '|') OR starts_with({0}, '- ') OR starts_with({0}, '* '))"
TAILED = "(SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN text || chr(10) || '| a | b.' WHEN 1 THEN text || chr(10) || chr(10) WHEN 2 THEN text || ' ``` code.' WHEN 3 THEN left(text, 90) WHEN 6 THEN text || chr(10) || '- item' || chr(10) || chr(10) WHEN 7 THEN text || chr(10) || chr(9) || '| a | b. ' WHEN 8 THEN text || chr(10) || '* item.' || chr(13) || chr(10) ELSE text || ' End.' END AS s FROM documents)"
BODY = "regexp_replace(s, '\\s+$', '')"


@query(
    f"""SELECT doc_id, strlen(s) >= 100 AND NOT {ROW.format(LAST.format('s'))} AND (length(s) - length(replace(s, '```', ''))) / 3 % 2 = 0
  AND (suffix(s, chr(10) || chr(10)) OR (strlen(s) > 300 AND regexp_matches({BODY}, '[.?!]$') AND NOT {ROW.format(LAST.format(BODY))})) AS boundary FROM {TAILED}"""
)
def t17_sentence_boundary(spark, d):
    i, t = F.col("doc_id") % 9, F.col("text")
    s = F.when(i == 0, F.concat(t, F.lit("\n| a | b."))).when(i == 1, F.concat(t, F.lit("\n\n"))).when(i == 2, F.concat(t, F.lit(" ``` code."))).when(i == 3, F.substring(t, 1, 90))
    s = s.when(i == 6, F.concat(t, F.lit("\n- item\n\n"))).when(i == 7, F.concat(t, F.lit("\n\t| a | b. "))).when(i == 8, F.concat(t, F.lit("\n* item.\r\n"))).otherwise(F.concat(t, F.lit(" End.")))
    return table(spark, d, "documents").select("doc_id", s.alias("s")).select("doc_id", T.sentence_boundary(F.col("s")).alias("boundary"))


HEADED = """h AS (SELECT conv_id, turn, side, list_filter(list_transform(list_filter(list_transform(string_split(s, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
  lambda x: starts_with(x, '#') OR (starts_with(x, '**') AND suffix(x, '**') AND strlen(x) > 4)), lambda x: trim(regexp_replace(lower(x), '[^\\p{L}\\p{N}]+', ' ', 'g'))), lambda x: x <> '') AS h FROM s)"""


@query(
    f"""WITH s AS (SELECT conv_id, turn, 'new' AS side, '#Part ' || conv_id % 3 || chr(10) || text || chr(10) || '   ##  Key: Points!' || chr(10) || '**Sum**' || chr(10) || '** Next Steps ' || turn % 2 || '**  ' || chr(10) || '****' AS s FROM conversations
    UNION ALL SELECT conv_id, turn, 'prior', text || chr(10) || '**part 1**' || chr(10) || '# Sum' || chr(10) || '###next -- steps 1' || chr(10) || 'Key points' FROM conversations), {HEADED}
  SELECT n.conv_id, n.turn, array_to_string(n.h, '|') AS headings, list_filter(n.h, lambda x: contains(x, ' ') AND list_contains(p.h, x))[1] AS repeated FROM h n JOIN h p ON p.conv_id = n.conv_id AND p.turn = n.turn AND p.side = 'prior' WHERE n.side = 'new'"""
)
def t18_headings(spark, d):
    """Headings of a text, and the first of them that an earlier text had."""
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    new = say("#Part ", (F.col("conv_id") % 3).cast("string"), "\n", F.col("text"), "\n   ##  Key: Points!\n**Sum**\n** Next Steps ", (F.col("turn") % 2).cast("string"), "**  \n****")
    prior = say(F.col("text"), "\n**part 1**\n# Sum\n###next -- steps 1\nKey points")
    rows = table(spark, d, "conversations").select("conv_id", "turn", new.alias("new"), prior.alias("prior"))
    return rows.select("conv_id", "turn", F.array_join(T.headings(F.col("new")), "|").alias("headings"), T.heading_repeat(F.col("new"), F.col("prior")).alias("repeated"))


#: The shortest end of 150 bytes or more, in characters.
END = "list_filter(range(1, 151), lambda k: strlen(right(new, k)) >= 150)[1]"


@query(
    f"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text || repeat(' ', CAST(doc_id % 100 AS INTEGER)) WHEN 2 THEN left(text, 80) ELSE left(text, 150) END AS new, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN left(text, length(text) // 2) ELSE text || '.' || text END AS prior FROM documents),
  e AS (SELECT *, {END} AS k FROM s), x AS (SELECT *, regexp_replace(right(new, k), '^\\s+|\\s+$', '', 'g') AS x FROM e)
  SELECT doc_id, CASE WHEN k IS NOT NULL AND strlen(x) >= 75 AND contains(prior, x) THEN strlen(new) - strlen(right(new, k)) END AS repeats_from FROM x"""
)
def t19_tail_repeats(spark, d):
    i, t = F.col("doc_id"), F.col("text")
    new = F.when(i % 4 == 0, t).when(i % 4 == 1, F.concat(t, F.repeat(F.lit(" "), (i % 100).cast("int")))).when(i % 4 == 2, F.substring(t, 1, 80)).otherwise(F.substring(t, 1, 150))
    prior = F.when(i % 3 == 0, t).when(i % 3 == 1, F.substring(t, F.lit(1), F.expr("length(text) div 2").cast("int"))).otherwise(F.concat(t, F.lit("."), t))
    rows = table(spark, d, "documents").select("doc_id", new.alias("new"), prior.alias("prior"))
    return rows.select("doc_id", T.tail_repeat(F.col("new"), F.col("prior")).cast("long").alias("repeats_from"))


@query(
    """SELECT conv_id, turn, array_to_string(list_filter([turn, conv_id, 7, CASE conv_id % 5 WHEN 1 THEN 1 WHEN 2 THEN 3 END, 1], lambda x: x IS NOT NULL), ',') AS cited FROM conversations"""
)
def t20_citations(spark, d):
    """Numbers cited in brackets of several kinds, and files by name; of two sources of one name the first counts."""
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    s = say("see [", F.col("turn").cast("string"), "], 〔#", F.col("conv_id").cast("string"), "), 〔#", F.col("conv_id").cast("string"), "】, (#9) and [#7】 but not (3), 【File_", (F.col("conv_id") % 5).cast("string"), ".PDF】, [some prose], [ file_1.pdf ]")
    chunks = F.array(*map(F.lit, ("[Source: file_1.pdf]\nText.", "no header", "[Source: FILE_2.pdf]", "[Source: file_1.pdf]\nMore.", "[Source: file_3.pdf] not a header")))
    found = F.transform(T.citation_numbers(s, chunks), lambda x: x.cast("string"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(found, ",").alias("cited"))


@query(f"WITH {COURSE_DOCS} SELECT doc_id, CASE WHEN orphaned THEN '[Source: ' || filename || ']' ELSE '[Source: ' || filename || ']' || chr(10) || kind END AS shown, filename AS source FROM course_docs")
def t21_source_header(spark, d):
    c = course_docs(spark, d).select("doc_id", T.masked_source(F.col("filename"), F.col("kind"), F.col("orphaned")).alias("shown"), "filename", "orphaned", "kind")
    return c.select("doc_id", "shown", F.coalesce(T.source_header(F.col("shown")), F.col("filename")).alias("source"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 1 THEN '[Source: ' || source || ']' ELSE '[Source: ' || source || ']' || chr(10) || sha256(text) END AS shown FROM documents")
def p4_hidden_documents(spark, d):
    """What a chunk shows of its document: the name alone where the document is hidden."""
    docs = table(spark, d, "documents")
    hidden = docs.where("doc_id % 6 = 1").select("doc_id", F.lit(True).alias("hidden"))
    rows = docs.select("doc_id", "source", F.sha2("text", 256).alias("body")).join(hidden, "doc_id", "left")
    return rows.select("doc_id", T.masked_source(F.col("source"), F.col("body"), F.coalesce("hidden", F.lit(False))).alias("shown"))


@query("SELECT doc_id, left(coalesce(nullif(regexp_replace(regexp_replace(text, '[^\\p{L}\\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled'), 120) AS slug FROM documents")
def t22_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", T.slug(F.col("text")).alias("slug"))


@query("SELECT c_custkey, TRY_CAST(nullif(regexp_extract(s, '([0-9]+)$', 1), '') AS BIGINT) AS n FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN c_name || 'x' ELSE c_name END AS s FROM customer)")
def t23_suffix_id(spark, d):
    s = F.when(F.col("c_custkey") % 7 == 0, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", T.suffix_id(s).alias("n"))


@query("SELECT page_id, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS hash FROM pages")
def t24_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(T.escaped(F.col("html")), 256).alias("hash"))


@query(
    """SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'id ' || page_id || '/é' WHEN 1 THEN NULL WHEN 3 THEN CAST(page_id AS VARCHAR) ELSE nullif(regexp_extract(regexp_replace(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1), '/+$', ''), '([^/]*)$', 1), '') END AS id FROM pages"""
)
def t25_url_id(spark, d):
    i, at = F.col("page_id"), F.regexp_replace("url", "[?#].*$", "")
    say = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    u = F.when(i % 6 == 0, say(at, "?x=1&p=&p=id+", i.cast("string"), "%2F%C3%A9#p=no")).when(i % 6 == 1, "https://play.example.org/?q=p").when(i % 6 == 3, say(at, "?p=", i.cast("string")))
    u = u.when(i % 6 == 4, say(at, ";v=1?up=2#a/b")).otherwise(say(at, "/"))
    return table(spark, d, "pages").select("page_id", T.url_id(u).alias("id"))


HOSTED = """(SELECT page_id, 'https://' || (['files.example.org/o/r/main/a', 'code.example.org/o/r/blob/main/d/b', 'code.example.org/o/r/releases/latest/download/c', 'code.example.org/o/r/tree/x', 'other.example.org/o/r/raw/x', 'files.example.org/o/a', 'code.example.org/o/r/raw/v1/../x', 'code.example.org/o/r/releases/download/v1/z'])[CAST(page_id % 8 AS INTEGER) + 1]
  || page_id || (['.pdf', '.PDF?x=1', '.txt'])[CAST(page_id % 3 AS INTEGER) + 1] AS u FROM pages)"""
PATHS = ("files.example.org/o/r/main/a", "code.example.org/o/r/blob/main/d/b", "code.example.org/o/r/releases/latest/download/c", "code.example.org/o/r/tree/x", "other.example.org/o/r/raw/x", "files.example.org/o/a", "code.example.org/o/r/raw/v1/../x", "code.example.org/o/r/releases/download/v1/z")


@query(
    f"""SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE CASE page_id % 8 WHEN 0 THEN 'o/r/main/a' || page_id WHEN 1 THEN 'o/r/raw/main/d/b' || page_id WHEN 2 THEN 'o/r/releases/latest/download/c' || page_id WHEN 7 THEN 'o/r/releases/download/v1/z' || page_id END || (['.pdf', '.PDF'])[CAST(page_id % 3 AS INTEGER) + 1] END AS path,
  (['notes.PDF', 'spec.pdf', 'fallback.pdf', 'week1.pdf'])[CAST(page_id % 4 AS INTEGER) + 1] AS name FROM {HOSTED}"""
)
def t26_hosted_pdf(spark, d):
    i = F.col("page_id")
    u = F.concat(F.lit("https://"), nth(PATHS, i % 8), i.cast("string"), nth((".pdf", ".PDF?x=1", ".txt"), i % 3))
    stored = nth(("notes.PDF", "spec.pdf.url", ".url", "week1.url"), i % 4)
    return table(spark, d, "pages").select("page_id", T.pdf_download(u, ("files.example.org",), ("code.example.org",)).alias("path"), T.pdf_filename(stored, F.lit("fallback.pdf")).alias("name"))


@query("SELECT c_custkey, coalesce(nullif(lower(trim(n)), ''), 'lti_' || c_nationkey || '_' || c_custkey) AS key FROM (SELECT *, CASE WHEN c_custkey % 9 = 0 THEN NULL WHEN c_custkey % 9 = 1 THEN '  ' ELSE ' ' || c_name END AS n FROM customer)")
def t27_user_key(spark, d):
    k = F.col("c_custkey")
    n = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, "  ").otherwise(F.concat(F.lit(" "), "c_name"))
    return table(spark, d, "customer").select("c_custkey", T.user_key(n, F.col("c_nationkey").cast("string"), k.cast("string")).alias("key"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ta' ELSE 'teacher' END AS role, c_custkey % 3 <> 0 AND c_custkey % 4 IN (1, 2) AS owner FROM customer")
def t28_member_role(spark, d):
    k = F.col("c_custkey")
    roles = F.when(k % 4 == 1, F.array(F.lit("x"), F.lit(" Kurs-/delkursansvarig, 2024"))).when(k % 4 == 2, F.array(F.lit("KURSANSVARIG"))).when(k % 4 == 3, F.array(F.lit("kursansvarig m.m."))).otherwise(F.array().cast("array<string>"))
    r = table(spark, d, "customer").select("c_custkey", T.member_role(F.when(k % 3 == 0, "student").otherwise("staff"), roles).alias("r"))
    return r.select("c_custkey", "r.role", "r.owner")


FIRST = ("amber", "brisk", "calm", "daring", "early", "fair", "gentle", "hardy", "idle", "jolly", "keen", "lively", "mellow", "noble", "opal", "proud")
SECOND = ("badger", "crane", "dove", "egret", "ferret", "grouse", "heron", "ibis", "jackal", "kestrel", "lynx", "marten", "newt", "otter", "plover", "quail")


@query()
def t29_pseudonyms(spark, d):
    return topics.pseudonyms(table(spark, d, "customer").select(F.lower("c_name").alias("name")), FIRST, SECOND, "salt")


CODE_LIST = ("MAR-ALGO", "NETSEC-DIST", "LOGIC (AB)", "LOGIC-S", "IB-VT2", "a (b [c) d] e", "x{y]z", "open (rest", "close) more", "S-AB", "(all)", "åö hi 7", "DA[HT23]-ISP")
#: What is left of each, by hand; null for the one that is empty.
CORES = ("ALGO", "NETSEC", "LOGIC", "LOGIC", "IB-VT2", "A-E", "XZ", "OPEN", "CLOSE-MORE", "S-AB", None, "ÅÖ-7", "DA-ISP")


def listed(names: tuple, i: str) -> str:
    return f"([{', '.join('NULL' if n is None else repr(n) for n in names)}])[CAST({i} % {len(names)} AS INTEGER) + 1]"


@query(f"SELECT o_orderkey, {listed(CORES, 'o_orderkey')} AS code FROM orders")
def t33_course_code(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.course_code(nth(CODE_LIST, F.col("o_orderkey") % len(CODE_LIST))).alias("code"))


LABELS = ("VT2024", " ht2023 ", "HT1999", "Spring", "vt20245", "HT2099")
LABEL_SQL = f"([{', '.join(repr(x) for x in LABELS)}])[CAST(o_orderkey % 6 AS INTEGER) + 1]"


@query(f"SELECT o_orderkey, regexp_matches(upper(trim(s)), '^[VH]T20[0-9]{{2}}$') AS ok FROM (SELECT o_orderkey, {LABEL_SQL} AS s FROM orders)")
def p18_semester_label(spark, d):
    return table(spark, d, "orders").select("o_orderkey", T.semester_ok(nth(LABELS, F.col("o_orderkey") % 6)).alias("ok"))


@query(
    f"SELECT o_orderkey, CASE WHEN regexp_matches(upper(trim(s)), '^[VH]T20[0-9]{{2}}$') THEN CAST(upper(trim(s))[3:6] AS DOUBLE) + CASE WHEN starts_with(upper(trim(s)), 'HT') THEN 0.5 ELSE 0.0 END ELSE -1 END AS key FROM (SELECT o_orderkey, {LABEL_SQL} AS s FROM orders)"
)
def t34_semester_key(spark, d):
    key = T.semester_key(nth(LABELS, F.col("o_orderkey") % 6))
    return table(spark, d, "orders").select("o_orderkey", F.when(key < 0, -1.0).otherwise(key).alias("key"))


REALMS = ("a@uni.example", "B@dept.uni.example", "c@otheruni.example", "@uni.example", "d@x@uni.example", "e", " a b@uni.example ", "a@x_y.uni.example", "a@uni.example@else.example", "uni.example@")


@query(f"SELECT c_custkey, len(string_split(s, '@')) > 1 AND ends_with('.' || lower(trim(string_split(s, '@')[-1])), '.uni.example') AND trim(s) NOT LIKE '@%' AS inside FROM (SELECT c_custkey, ([{', '.join(repr(x) for x in REALMS)}])[CAST(c_custkey % 10 AS INTEGER) + 1] AS s FROM customer)")
def t35_realm(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.in_realm(nth(REALMS, F.col("c_custkey") % 10), "uni.example").alias("inside"))


@query("SELECT o_orderkey, CASE WHEN month(o_orderdate) <= 6 THEN 'VT' || year(o_orderdate) || ',HT' || year(o_orderdate) ELSE 'HT' || year(o_orderdate) || ',VT' || (year(o_orderdate) + 1) END AS semesters FROM orders")
def t36_semesters_of_day(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.array_join(T.semesters_of(F.col("o_orderdate")), ",").alias("semesters"))


@query(
    """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'error: no such tool' WHEN 1 THEN '3 results' WHEN 2 THEN '2 results (' || conv_id + 1 || ' more omitted)' WHEN 3 THEN '1 results' ELSE CASE WHEN length(text) > 120 THEN left(text, 120) || '…' ELSE text END END AS summary FROM conversations"""
)
def t37_tool_summary(spark, d):
    t = F.col("turn") % 5
    m = F.when(t == 0, '{"error": "no such tool"}').when(t == 1, "[1, {}, null]").when(t == 2, F.concat(F.lit('{"results": [1, 2], "truncated_omitted": '), (F.col("conv_id") + 1).cast("string"), F.lit("}"))).when(t == 3, '{"results": [{"a": 1}]}').otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.tool_summary(m).alias("summary"))


@query("SELECT conv_id, CASE WHEN length(t) > 60 THEN regexp_replace(left(t, 60), '^\\s+|\\s+$', '', 'g') || '...' ELSE t END AS title FROM (SELECT conv_id, arg_min(text, turn) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def w8_title(spark, d):
    first = users(spark, d).groupBy("conv_id").agg(F.min_by("text", "turn").alias("t"))
    return first.select("conv_id", T.title(F.col("t")).alias("title"))


@query("SELECT page_id, page_id % 8 IN (0, 1, 2, 4) AS empty FROM pages")
def p17_no_text(spark, d):
    i = F.col("page_id") % 8
    h = F.when(i == 0, "<p> <br></p>\n").when(i == 1, "\xa0 > <p").when(i == 2, "<p><b\n>\u2003</p>").when(i == 3, "<p> a < b").when(i == 4, "").otherwise(F.concat(F.lit("x"), "html"))
    return table(spark, d, "pages").select("page_id", T.no_text_in_html(h).alias("empty"))


@query(
    """WITH r AS (SELECT conv_id, row_number() OVER w AS i, sum(strlen(text) + 2) OVER w + row_number() OVER w + 1 AS length FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
  g AS (SELECT conv_id, count(*) AS n, max(length) AS whole, count(*) FILTER (WHERE length + 80 <= 1000) AS fit FROM r GROUP BY conv_id) SELECT conv_id, CASE WHEN whole <= 1000 THEN n ELSE fit END AS kept, n - CASE WHEN whole <= 1000 THEN n ELSE fit END AS omitted FROM g"""
)
def k8_budgeted_prefix(spark, d):
    return topics.kept_prefix(table(spark, d, "conversations"), "conv_id", "turn", F.octet_length("text") + 2, 1000)


@query("SELECT event_id, TRY_CAST(json_extract_string(p, '$.k') AS BIGINT) AS k FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not json' WHEN 1 THEN '{\"k\": \"word\"}' ELSE props END AS p FROM events) WHERE json_valid(p) UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 4 = 0")
def s15_json_with_fallback(spark, d):
    i = F.col("event_id")
    p = F.when(i % 4 == 0, "not json").when(i % 4 == 1, '{"k": "word"}').otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.from_json(p, "k long")["k"].alias("k"))


@query(
    """WITH k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'invalid_bool' WHEN 2 THEN CASE WHEN k > 50 THEN 'out_of_range' END WHEN 3 THEN 'invalid_int' WHEN 4 THEN CASE WHEN k + 0.5 > 50 THEN 'out_of_range' END
  WHEN 5 THEN CASE WHEN event_id % 3 = 0 THEN 'too_long' END WHEN 6 THEN CASE WHEN event_id % 3 <> 0 THEN 'invalid_enum' END ELSE 'invalid_string' END AS error FROM k"""
)
def p20_knob_errors(spark, d):
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    kind = nth(("bool", "bool", "int", "int", "float", "text", "enum", "text"), i % 8)
    word = F.when(i % 3 == 0, '"' + "é" * 30 + '"').otherwise('"on"')
    raw = F.when(i % 8 == 0, "true").when(i % 8 == 1, "1").when(i % 8 == 2, k).when(i % 8 == 3, F.concat(k, F.lit(".5"))).when(i % 8 == 4, F.concat(k, F.lit(".5"))).when(i % 8 == 5, word).when(i % 8 == 6, F.when(i % 3 == 0, '"a"').otherwise('"on"')).otherwise("12")
    error = T.knob_error(kind, raw, F.lit(0), F.lit(50), F.array(F.lit("a"), F.lit("b")))
    return table(spark, d, "events").select("event_id", error.alias("error"))


@query(f"WITH {COURSE_DOCS} SELECT doc_id, 'course_' || course_id || CASE WHEN doc_id % 3 > 1 THEN '_v' || doc_id % 3 ELSE '' END AS collection FROM course_docs")
def s13_collection_name(spark, d):
    from ..sources.tables import collection_name

    return course_docs(spark, d).select("doc_id", collection_name(F.col("course_id"), F.col("doc_id") % 3).alias("collection"))


def packed(pdf):
    """A backup of a few pages: two sections, of which the second is hidden, and an activity for each page."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz") as tar:
        for name, body in backup_files(zip(pdf["page_id"].tolist(), pdf["url"], strict=True)):
            info = tarfile.TarInfo(name)
            info.size = len(body.encode())
            tar.addfile(info, io.BytesIO(body.encode()))
    return pdf.iloc[:1][["path"]].assign(content=[out.getvalue()])


def backup_files(pages):
    for k in (1, 2):
        yield f"sections/section_{k}/section.xml", f'<section id="{k}"><visible>{2 - k}</visible></section>'
    for i, url in pages:
        date = f'{{"op":"&amp;","c":[{{"type":"date","d":"&gt;=","t":{i % 100}}}]}}' if i % 3 == 0 else "$@NULL@$"
        yield f"activities/page_{i}/module.xml", f'<module id="{i}"><modulename>page</modulename><sectionid>{2 if i % 4 == 3 else 1}</sectionid><visible>{int(i % 5 != 0)}</visible><availability>{date}</availability></module>'
        yield f"activities/page_{i}/page.xml", f'<activity id="{i}"><page id="{i}"><name>{html.escape(url)}</name><content>Body of {i}</content></page></activity>'


@query(
    """SELECT 'backup-' || page_id // 20 AS archive, 'activities/page_' || page_id AS folder, 'page' AS kind, left(coalesce(nullif(regexp_replace(regexp_replace(url, '[^\\p{L}\\p{N}_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'untitled'), 120) AS title, 'Body of ' || page_id AS text
  FROM pages WHERE page_id % 5 <> 0 AND (page_id % 3 <> 0 OR page_id % 100 <= 50)"""
)
def s6_archives(spark, d):
    """Activities that are visible at time 50 in backups of 20 pages each, in hidden sections too."""
    pages = table(spark, d, "pages").select(F.concat(F.lit("backup-"), F.expr("page_id div 20").cast("string")).alias("path"), "page_id", "url")
    files = pages.groupBy("path").applyInPandas(packed, "path string, content binary")
    return archives.visible_items(archives.archive_rows(files), 50)
