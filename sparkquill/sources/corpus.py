"""Files and sections, from Parquet tables or from folders of Markdown and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkquill.functions.text import fold

ZONE_RANK = {"distilled": 0, "raw": 1, "outputs": 2}
ZONE_WEIGHT = {"distilled": 1.0, "raw": 1.0, "outputs": 0.7}
NOTE_EXTENSIONS = ("md", "markdown", "txt", "pdf")
FRONTMATTER_HEAD, STATUS_HEAD = 8192, 2048
PDF_BLOCK = 1500
#: Bytes a core below which an input is dealt anew.
LEAST_SPLIT = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores before work that costs more than their transport, where the input is too small to come in enough splits."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * LEAST_SPLIT else rows


def fingerprint(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A hash of path, size and change time of a table's files; no row is read."""
    files = table(spark, sf_dir, name).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return files.agg(F.coalesce(F.sha1(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "file_path", "file_size", "file_modification_time"))), "\n")), F.lit("")).alias("h")).first()["h"][:16]


def zone_of(number: Column) -> Column:
    """The zone that a document stands in: of ten, two are raw and one is an output."""
    return F.when((number % 10).isin(7, 8), "raw").when(number % 10 == 9, "outputs").otherwise("distilled")


def files_of(documents: DataFrame) -> DataFrame:
    """documents as files: file_id, source, zone, rel, title (first line), lang, text."""
    return documents.select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_id"),
        "doc_id",
        "source",
        zone_of(F.col("doc_id")).alias("zone"),
        F.col("doc_id").cast("string").alias("rel"),
        F.substring_index("text", "\n", 1).alias("title"),
        "lang",
        "text",
    )


def lines_of(files: DataFrame, *keep: str) -> DataFrame:
    """A row per line: the kept columns, line (from 1), body."""
    return files.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("place", "body")).withColumn("line", F.col("place") + 1).drop("place")


def first_zone(files: DataFrame) -> DataFrame:
    """One row per file_id: that of the first zone it is found in."""
    rank = F.create_map(*(F.lit(x) for pair in ZONE_RANK.items() for x in pair))[F.col("zone")]
    best = Window.partitionBy("file_id").orderBy(rank, "source", "rel")
    return files.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def config_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """sources and context prefixes of a JSON configuration, with defaults for what it leaves out."""
    raw = spark.read.option("multiLine", True).json(path)
    has = set(raw.columns)
    fields = set()
    if "sources" in has:
        fields = set(raw.schema["sources"].dataType.elementType.names)
    one = raw.select(F.explode("sources").alias("s")) if "sources" in has else None

    def get(name: str, default: Column) -> Column:
        return F.coalesce(F.col(f"s.{name}"), default).alias(name) if name in fields else default.alias(name)

    def listed(name: str) -> Column:
        return get(name, F.array(F.lit(name)))

    sources = spark.createDataFrame([], "id string, label string, root string, distilled array<string>, raw array<string>, outputs array<string>")
    if one is not None:
        sources = one.select(F.col("s.id").alias("id"), get("label", F.col("s.id")), get("root", F.lit(".")), listed("distilled"), listed("raw"), listed("outputs"))
    prefixes = spark.createDataFrame([], "prefix string, text string")
    if "context" in has:
        prefixes = raw.select(F.explode(F.from_json(F.to_json("context"), "map<string,string>")).alias("prefix", "text"))
    return {"sources": sources, "context": prefixes.orderBy(F.length("prefix"), "prefix")}


def scan_folder(spark: SparkSession, root: str, source: str, zone: str, ignore: tuple[str, ...] = ()) -> DataFrame:
    """Notes below a folder: file_id, source, zone, rel, sig (time and size), size, content; hidden and ignored paths are left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(NOTE_EXTENSIONS) + "}").load(root)
    base = "/" + root.removeprefix("file:").strip("/") + "/"
    rel = F.substring_index("path", base, -1)
    parts = F.split(rel, "/")
    hidden = F.exists(parts, lambda p: p.startswith(".") | p.isin(*ignore)) if ignore else F.exists(parts, lambda p: p.startswith("."))
    sig = F.concat_ws(":", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string"))
    return found.where(~hidden).select(F.concat(F.lit(f"{source}/"), rel).alias("file_id"), F.lit(source).alias("source"), F.lit(zone).alias("zone"), rel.alias("rel"), sig.alias("sig"), F.col("length").alias("size"), "content")


def text_of(files: DataFrame) -> DataFrame:
    """Adds text, with CRLF made LF; null for PDF content, which extract_pdf() reads."""
    return files.withColumn("text", F.when(~F.lower("rel").endswith(".pdf"), F.regexp_replace(F.decode("content", "UTF-8"), "\r\n", "\n")))


def frontmatter(text: Column) -> Column:
    """The leading block between --- and --- or ... as a map of strings; of repeated keys the last counts."""
    block = F.regexp_extract(F.substring(text, 1, FRONTMATTER_HEAD), r"\A---\n([\s\S]*?)\n(?:---|\.\.\.)(?:\n|\z)", 1)
    entries = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[^\s:#][^:]*:"))
    pairs = F.transform(entries, lambda x: F.struct(F.trim(F.regexp_extract(x, "^([^:]+):", 1)).alias("key"), F.regexp_replace(F.trim(F.regexp_extract(x, r"^[^:]+:\s*(.*)$", 1)), "^([\"'])(.*)\\1$", "$2").alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def listed_values(text: Column, key: str) -> Column:
    """A frontmatter list, inline ([a, b]) or a block of "- item" lines."""
    head = F.substring(text, 1, FRONTMATTER_HEAD)
    inline = F.regexp_extract(head, rf"(?m)^{key}:\s*\[([^\]\n]*)\]", 1)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*-(?!-)[^\n]*\n?)+)", 1)
    found = F.when(inline != "", F.split(inline, r"\s*,\s*")).otherwise(F.regexp_extract_all(block, F.lit(r"-\s*([^\n]*)"), F.lit(1)))
    return F.filter(F.transform(found, lambda x: F.regexp_replace(F.trim(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def status_of(text: Column) -> Column:
    """draft, canon or null, from the head of a note."""
    found = F.lower(F.regexp_extract(F.substring(text, 1, STATUS_HEAD), r"(?m)^statut\s*:\s*['\"]?([A-Za-z]+)['\"]?\s*$", 1))
    return F.when(found.isin("draft", "canon"), found)


def pdf_markdown(raw: Column, name: Column) -> Column:
    """Text with form feeds as Markdown: a heading per page that is not blank; pages are numbered with blank ones."""
    pages = F.transform(F.split(raw, "\f"), lambda p, i: F.struct((i + 1).alias("n"), F.regexp_replace(p, r"^\s+|\s+\z", "").alias("body")))
    kept = F.filter(pages, lambda p: p["body"] != "")
    body = F.array_join(F.transform(kept, lambda p: F.concat(F.lit("## Page "), p["n"].cast("string"), F.lit("\n\n"), p["body"])), "\n\n")
    return F.concat(F.lit("# "), name, F.lit("\n\n"), F.when(F.size(kept) > 0, body).otherwise("(no text)"))


def extract_pdf(files: DataFrame) -> DataFrame:
    """file_id and raw text of PDF files, with whatever library is there; null where none is or it fails."""
    import pandas as pd

    @F.pandas_udf("string")
    def run(content: pd.Series) -> pd.Series:
        import io

        def one(data: bytes) -> str | None:
            try:
                from pypdf import PdfReader

                return "\f".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(data)).pages)
            except Exception:  # no library, or a damaged file: the lint report lists it
                return None

        return content.map(one)

    return files.where(F.lower("rel").endswith(".pdf")).select("file_id", "sig", run("content").alias("raw"))


def pdf_cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """PDF files without a cached extract of the same signature."""
    key = F.sha1(F.col("file_id"))
    return files.where(F.lower("rel").endswith(".pdf")).withColumn("key", key).join(cache.select("key", "sig"), ["key", "sig"], "left_anti")


def registry(lines: DataFrame) -> DataFrame:
    """Paths below raw/ that a registry names: the first of each line."""
    return lines.select(F.regexp_extract("value", r"(raw/[^\s—,;]+)", 1).alias("path")).where("path <> ''")


def usage_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ts string, query string, confidence string, n_results int, chars long").option("sep", "\t").csv(path)


def append_usage(rows: DataFrame, path: str) -> None:
    """Appends ts, query, confidence, n_results, chars; tabs and line ends of queries become spaces."""
    rows.withColumn("query", F.regexp_replace("query", r"[\t\r\n]+", " ")).select("ts", "query", "confidence", "n_results", "chars").write.mode("append").option("sep", "\t").csv(path)


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Messages of JSON-line transcripts: file, seq, role, is_meta, text; lines that do not parse are left out."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"), "value")
    kind = "type string, isMeta boolean, message struct<content: string>"
    parsed = lines.withColumn("j", F.from_json("value", kind)).where("j.type is not null")
    blocks = F.from_json("j.message.content", "array<struct<type: string, text: string>>")
    joined = F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")
    content = F.when(F.col("j.message.content").startswith("["), joined).otherwise(F.col("j.message.content"))
    return parsed.select("file", "seq", F.col("j.type").alias("role"), F.coalesce("j.isMeta", F.lit(False)).alias("is_meta"), F.coalesce(content, F.lit("")).alias("text"))


def page_of_lines(files: DataFrame, begin: int, end: int, most_lines: int = 2000) -> DataFrame:
    """Lines begin to end of each file, at most most_lines of them: file_id, total, line_start, line_end, text."""
    all_lines = F.split("text", "\n", -1)
    last = F.least(F.lit(end), F.lit(begin + most_lines - 1), F.size(all_lines))
    return files.select("file_id", F.size(all_lines).alias("total"), F.lit(begin).alias("line_start"), last.alias("line_end"), F.array_join(F.slice(all_lines, F.lit(begin), F.greatest(last - begin + 1, F.lit(0))), "\n").alias("text"))


def resolve_file(files: DataFrame, wanted: str) -> DataFrame:
    """The file that an argument names: by id, path, folded path, name or part of it, in this order."""
    name = F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.[^.]+$", "")
    w, folded = F.lit(wanted), fold(F.lit(wanted))
    steps = [F.col("file_id") == w, F.col("rel") == w, fold(F.col("file_id")) == folded, fold(F.col("rel")) == folded, F.regexp_replace(fold(F.col("rel")), r"\.[^.]+$", "") == folded, fold(name) == folded, F.col("file_id").endswith(wanted), fold(F.col("file_id")).contains(folded)]
    priority = F.coalesce(*[F.when(step, i) for i, step in enumerate(steps)])
    return files.withColumn("priority", priority).where("priority is not null").orderBy("priority", "file_id").limit(1).drop("priority")
