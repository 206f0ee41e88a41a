"""Queries that drive whole paths: files in, tables out, each with the SQL that says what must come of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.config import Settings
from brindle.functions import text
from brindle.functions.filters import compile_filter
from brindle.operators import chunk, evaluate, index, ingest, search, versions
from brindle.plans.recovery import checkpoint, delete, shared_path
from brindle.plans.store import Store
from brindle.plans.tables import table
from brindle.queries import _HYBRID, AS_OF, STORED_SQL, _hybrid_items, _vector_queries, metadata_rows, query, stored
from brindle.sources import files


@query("filter_empty", "SELECT doc_id FROM documents")
def filter_empty(spark: SparkSession, sf: str) -> DataFrame:
    """No filter lets everything through."""
    return metadata_rows(spark, sf).filter(compile_filter({}, F.col("metadata")) & compile_filter(None, F.col("metadata"))).select("doc_id")


@query("doc_keys", r"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN source WHEN 1 THEN doc_id || '.txt' WHEN 2 THEN '' ELSE 'a ' || source END AS doc_key FROM documents""")
def doc_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys given with white space around them, empty, blank and with white space inside."""
    own = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" \t"), "source", F.lit("\n"))).when(F.col("doc_id") % 4 == 1, "").when(F.col("doc_id") % 4 == 2, "  ").otherwise(F.concat(F.lit("a "), "source"))
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", versions.doc_key(own, F.concat(F.col("doc_id").cast("string"), F.lit(".txt "))).alias("doc_key"))


# ---- loaders


@query("loader_dispatch", """
SELECT doc_id || ext AS filename, CASE ext WHEN '.TXT' THEN 'text' WHEN '.md' THEN 'markdown' WHEN '.Markdown' THEN 'markdown' WHEN '.htm' THEN 'html' END AS file_type,
  CASE ext WHEN '.TXT' THEN false WHEN '.xyz' THEN NULL WHEN '.json' THEN NULL ELSE true END AS structured, ext IN ('.xyz', '.json') AS failed
FROM (SELECT doc_id, ['.TXT', '.md', '.Markdown', '.htm', '.json', '.xyz'][doc_id % 6 + 1] AS ext FROM documents)""")
def loader_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Loaders by extension in any case; prose is no JSON, and unknown extensions have none."""
    extension = F.element_at(F.array(*[F.lit(x) for x in (".TXT", ".md", ".Markdown", ".htm", ".json", ".xyz")]), (F.col("doc_id") % 6 + 1).cast("int"))
    given = table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), extension).alias("filename"), F.concat(F.lit("Text of "), "source").cast("binary").alias("content"))
    return files.sections(given).select("filename", "file_type", "structured", F.col("error").isNotNull().alias("failed"))


@query("decode_bytes", r"""SELECT doc_id || '.txt' AS filename, regexp_replace(coalesce(text, ''), '[^\x00-\x7F\x{A0}-\x{FF}]', '~', 'g') AS text FROM documents""")
def decode_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """Texts as bytes, in turn UTF-8, UTF-8 with its mark, and Latin-1, whose letters are those of Windows-1252."""
    plain = F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\x00-\x7F\xA0-\xFF]", "~")
    utf8 = plain.cast("binary")
    data = F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode(plain, "ISO-8859-1"))
    return files.sections(table(spark, sf, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), data.alias("content"))).select("filename", "text")


@query("html_sections", r"""
SELECT doc_id || '.html' AS filename, chr(10) || chr(10) || '## Part ' || doc_id || chr(10) || chr(10) || source || ' & co' || chr(10) || 'end' AS text, '{"title": "Page ' || doc_id || '"}' AS metadata FROM documents""")
def html_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a title, a script, a menu, a heading of two elements and an entity."""
    number = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit("<html><head><title>Page "), number, F.lit("</title><style>x</style></head><body><nav>menu</nav><h2>Part <b>"), number,
        F.lit("</b></h2><p>"), "source", F.lit(" &amp; co</p><script>1 < 2</script><i>end</i><footer>f</footer></body></html>"),
    )
    got = files.sections(table(spark, sf, "documents").select(F.concat(number, F.lit(".html")).alias("filename"), page.cast("binary").alias("content")))
    return got.select("filename", "text", "metadata")


@query("scan_folder", "SELECT 'r' || n_regionkey AS folder, 'same.txt' AS filename, n_name AS text, CAST(strlen(n_name) AS BIGINT) AS size_bytes FROM (SELECT n_regionkey, min(n_name) AS n_name FROM nation GROUP BY ALL)")
def scan_folder(spark: SparkSession, sf: str) -> DataFrame:
    """A folder for each region with a file of one name and one of no known type; read with all subfolders."""
    folder = shared_path(spark, "scan")
    for r in table(spark, sf, "nation").groupBy("n_regionkey").agg(F.min("n_name").alias("name")).collect():  # a file for each of a few regions
        for name in ("same.txt", "other.bin"):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/deep/r{r.n_regionkey}/{name}")
            stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
            stream.write(bytearray(r["name"].encode()))
            stream.close()
    found = files.read_files(spark, folder)
    texts = files.sections(found, "path").select(F.col("file").alias("path"), "text")
    out = checkpoint(found.join(texts, "path").select(F.element_at(F.split("path", "/"), -2).alias("folder"), "filename", "text", "size_bytes"))
    delete(spark, folder)
    return out


# ---- questions


def _questions_file(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as a file of labelled questions, read back."""
    items = table(spark, sf, "benchmark")
    number = F.col("item_id")
    wanted = F.array(F.struct(F.concat(number.cast("string"), F.lit(".txt")).alias("filename")))
    reference = F.when(number % 3 != 0, F.concat(F.lit("answer "), number.cast("string")))
    case = F.struct(F.concat(F.lit("q"), number.cast("string")).alias("id"), F.coalesce("text", F.lit("?")).alias("question"), F.when(number % 2 == 0, wanted).alias("expected"), reference.alias("reference"))
    folder = shared_path(spark, "questions")
    items.orderBy("item_id").select(F.to_json(case)).coalesce(1).write.text(folder)
    cases = files.read_cases(spark, folder)
    delete(spark, folder)
    return cases


_QUESTIONS = "q AS (SELECT 'q' || item_id AS id, text AS question, CASE WHEN item_id % 2 = 0 THEN item_id || '.txt' END AS filename, CASE WHEN item_id % 3 <> 0 THEN 'answer ' || item_id END AS reference, row_number() OVER (ORDER BY item_id) AS seq FROM benchmark)"


@query("labelled_questions", f"WITH {_QUESTIONS} SELECT id, question, filename, reference, CAST(seq AS INTEGER) AS seq FROM q")
def labelled_questions(spark: SparkSession, sf: str) -> DataFrame:
    return _questions_file(spark, sf).select("id", "question", F.try_element_at("expected", F.lit(1))["filename"].alias("filename"), "reference", "seq")


@query("case_selection", f"WITH {_QUESTIONS}, o AS (SELECT * FROM q WHERE id <> 'q4') SELECT id, CAST(seq AS INTEGER) AS seq FROM o WHERE reference IS NOT NULL ORDER BY seq LIMIT 7")
def case_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The first seven questions with a reference, of all but one."""
    cases = _questions_file(spark, sf)
    only = [f"q{i}" for i in range(cases.count() + 10) if i != 4]
    return evaluate.select_cases(cases, only, 7)[0].select("id", "seq")


@query("eval_page_and_text", """
WITH d AS (SELECT doc_id, source, text, CAST(doc_id % 7 AS INTEGER) AS page, doc_id || '.txt' AS filename FROM documents)
SELECT source AS id, count(*) FILTER (WHERE page = 3 AND contains(lower(text), 'the')) > 0 AS found FROM d GROUP BY source""")
def eval_page_and_text(spark: SparkSession, sf: str) -> DataFrame:
    """Expected is page 3 of any file with the letters THE; results are all documents of a source."""
    docs = table(spark, sf, "documents")
    wanted = F.array(F.struct(F.lit(None).cast("string").alias("filename"), F.lit(3).alias("page"), F.lit("THE").alias("contains")))
    cases = docs.select(F.col("source").alias("id")).distinct().select("id", F.col("id").alias("question"), wanted.alias("expected"))
    results = docs.select(F.col("source").alias("id"), (F.col("doc_id") + 1).alias("rank"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), (F.col("doc_id") % 7).cast("int").alias("page"), "text")
    states = cases.select("id", F.lit("ok").alias("status"), F.lit(True).alias("reranked"), F.lit(1.0).alias("took_ms"))
    return evaluate.score_cases(cases, results, states).select("id", (F.col("found") > 0).alias("found"))


# ---- stores


_WINDOWS = "unnest(range(CASE WHEN n = 0 THEN 0 WHEN n <= 64 THEN 1 ELSE CAST(ceil((n - 64) / 48.0) AS INTEGER) + 1 END)) AS i"


@query("ingested_chunks", f"""
WITH f AS (SELECT n, min(doc_id) AS doc_id FROM (SELECT doc_id, CAST(n_chars % 300 AS INTEGER) AS n FROM documents) WHERE n > 0 GROUP BY n), c AS (SELECT doc_id, n, {_WINDOWS} FROM f)
SELECT doc_id || '.txt' AS filename, CAST(i AS INTEGER) AS chunk_index, CAST(48 * i AS INTEGER) AS char_start, CAST(least(48 * i + 64, n) AS INTEGER) AS char_end, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS num_chunks,
  'text' AS file_type, 1 AS version, CAST(n AS BIGINT) AS size_bytes FROM c""")
def ingested_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """What two commits leave in a store: files of one letter repeated, of which many are equal; chunks with their documents."""
    length = (F.col("n_chars") % 300).cast("int")
    docs = table(spark, sf, "documents").select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("path"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.repeat(F.lit("x"), length).cast("binary").alias("content"))
    folder = shared_path(spark, "store")
    store = Store(spark, folder)
    made = ingest.Ingestor(store, settings=Settings(chunk_size=64, chunk_overlap=16, analyser="simple"))
    middle = docs.agg(F.max("path")).first()[0][:-1] + "5" if not docs.isEmpty() else ""
    for part in (docs.filter(F.col("path") <= F.lit(middle)), docs.filter(F.col("path") > F.lit(middle))):
        made.ingest(part)
    documents = store.read("documents").select(F.col("id").alias("document_id"), "filename", "num_chunks", "file_type", "version", "size_bytes")
    out = checkpoint(store.read("chunks").join(documents, "document_id").select("filename", "chunk_index", "char_start", "char_end", "num_chunks", "file_type", "version", "size_bytes"))
    delete(spark, folder)
    return out


@query("searchable_chunks", f"""
WITH {STORED_SQL} SELECT s.id, s.filename FROM stored s JOIN documents d ON s.seq = d.doc_id
WHERE is_current AND valid_from <= DATE '{AS_OF}' AND coalesce(valid_until >= DATE '{AS_OF}', true) AND d.lang IN ('en', 'de')""")
def searchable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks, here one for each document, of current documents that are in force, under a filter."""
    owners = stored(spark, sf).withColumn("file_type", F.lit("text"))
    pieces = metadata_rows(spark, sf).select(F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("id"), "metadata").withColumn("document_id", F.col("id"))
    return search.searchable(pieces, owners, F.lit(AS_OF), {"lang": {"$in": ["en", "de"]}}).select("id", "filename")


@query("candidate_depth", _HYBRID.replace("rank <= 40", "rank <= 12") + "SELECT query_id, id, found_by FROM fused")
def candidate_depth(spark: SparkSession, sf: str) -> DataFrame:
    """As many candidates of either search as results are asked for, if that is more than the candidates asked for."""
    items, queries = _hybrid_items(spark, sf)
    return search.hybrid(items, queries, 3, 12).select("query_id", "id", "found_by")


@query("vector_index_topk")
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest vectors of every vector divisible by 100, found in the index; a test measures the recall."""
    folder = shared_path(spark, "index")
    items = table(spark, sf, "embeddings")
    index.build(items, folder, id_col="vec_id")
    out = checkpoint(index.batch_topk(spark, folder, _vector_queries(spark, sf), 10))
    delete(spark, folder)
    return out.select("query_id", F.col("id").alias("vec_id"), F.round("vector_score", 4).alias("vector_score"), "rank")


# ---- chunks and words


@query("chunk_headings", """
WITH s AS (SELECT doc_id, CAST(n_chars % 5 + 1 AS INTEGER) AS n, unnest(range(CAST(n_chars % 5 + 1 AS INTEGER))) AS i FROM documents)
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, '## Part ' || i || chr(10) || 'word word word word word word word word word word' AS content, CAST(61 * i AS INTEGER) AS char_start FROM s""")
def chunk_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Markdown of one to five parts: each heading begins a chunk, although more would fit than one line."""
    parts = F.transform(F.sequence(F.lit(0), (F.col("n_chars") % 5).cast("int")), lambda i: F.concat(F.lit("## Part "), i.cast("string"), F.lit("\n" + " ".join(["word"] * 10) + " ")))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(parts, "\n").alias("text"), F.lit(True).alias("structured"))
    return chunk.chunk(docs, 70, 0, "doc_id", "text", "structured").select(F.col("id").alias("doc_id"), "chunk_index", "content", "char_start")


@query("english_tokens", "SELECT doc_id, doc_id || ' ' || doc_id || '-' || n_chars || ' ' || doc_id || ' ' || n_chars || ' ' || source AS lexemes FROM documents")
def english_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Words that have no stem: common ones go, and one joined by a hyphen stands before its parts."""
    number, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    words = F.concat(F.lit("The "), number, F.lit(" and, at "), number, F.lit("-"), n, F.lit("; WAS IT "), F.upper("source"), F.lit("?"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.lexemes(words, "english"), " ").alias("lexemes"))
