"""Delimited files, cell grids and documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import blank_null, source_slug, unique_key
from ..functions.text import normalize, parse_price, parse_ts
from ..operators.lineage import cut_lineage

#: Names under which an import may give each field, folded.
ALIASES: Mapping[str, tuple[str, ...]] = {
    "title": ("title", "name", "название", "наименование", "предмет", "предмет закупки"),
    "url": ("url", "link", "ссылка", "адрес"),
    "source": ("source", "источник", "площадка", "этп"),
    "tender_number": ("number", "номер", "номер закупки", "номер процедуры", "извещение"),
    "customer": ("customer", "заказчик", "организатор"),
    "region": ("region", "регион", "место поставки", "адрес поставки"),
    "price": ("price", "сумма", "нмцк", "начальная цена", "цена"),
    "deadline": ("deadline", "срок подачи", "дата окончания", "окончание подачи"),
    "published_at": ("published at", "опубликовано", "дата публикации", "размещено"),
    "raw_text": ("raw text", "описание", "текст"),
}


def fold_header(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(name, "[\ufeff]", "")), r"[\s_]+", " "))


def _file_name() -> Column:
    return F.url_decode(F.replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), F.lit("+"), F.lit("%2B")))


def _headers(spark: SparkSession, path: str) -> DataFrame:
    """file, its first line's folded names (`_names`) and its delimiter (`_sep`)."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^\ufeff", "").alias("line"), _file_name().alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")).alias("nth"))
    heads = lines.groupBy("file").agg(F.min_by("line", "nth").alias("line"))
    count = lambda c: F.length("line") - F.length(F.replace("line", F.lit(c), F.lit("")))
    sep = F.when(count(";") >= count(","), ";").otherwise(",")
    # a delimiter within quotes stands before an odd number of quotes
    cells = F.split("line", F.concat(sep, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)')))
    return heads.select("file", sep.alias("_sep"), F.transform(cells, lambda c: fold_header(F.replace(F.regexp_replace(F.trim(c), r'^"|"$', ""), F.lit('""'), F.lit('"')))).alias("_names"))


def read_delimited(spark: SparkSession, path: str, aliases: Mapping[str, Sequence[str]] = ALIASES) -> tuple[DataFrame, DataFrame]:
    """Import files to notices and rejects (file, line, reason). A file's first line is its header and settles its delimiter.

    Records may go over several lines within quotes. A row needs a title and a number or
    link; bad rows do not stop a file. Without a link it is import://file/number; the source is
    import- and the slug of its name or the file's; without a description the text is all
    known values of the row.
    """
    # one row per file: it goes to the records, whose few files would else be the keys of a shuffle
    heads = cut_lineage(_headers(spark, path))
    kinds = heads.groupBy("_sep").agg(F.max(F.size("_names")).alias("width")).collect()  # one row per delimiter
    parts = []
    for kind in kinds or [{"_sep": ";", "width": 1}]:
        names = [f"c{k}" for k in range(kind["width"])]
        records = spark.read.options(sep=kind["_sep"], header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8").schema(", ".join(f"{c} string" for c in names)).csv(path)
        parts.append(records.select(F.array(*names).alias("_cells"), _file_name().alias("file"), F.monotonically_increasing_id().alias("_n")).join(F.broadcast(heads.where(F.col("_sep") == kind["_sep"])), "file"))
    rows = reduce(DataFrame.union, parts).withColumn("_cells", F.slice("_cells", 1, F.size("_names")))
    place = lambda names: F.array_min(F.array_compact(F.array(*[F.nullif(F.array_position("_names", n).cast("int"), F.lit(0)) for n in names])))
    cell = {f: blank_null(F.trim(F.try_element_at("_cells", place(names)))) for f, names in aliases.items()}
    rows = rows.withColumns({f"_{f}": c for f, c in cell.items()})
    reason = F.when(F.col("_title").isNull(), "no_title").when(F.col("_tender_number").isNull() & F.col("_url").isNull(), "no_number_or_url")
    rejects = rows.where(reason.isNotNull()).select("file", F.concat_ws(";", F.transform("_cells", lambda c: F.coalesce(c, F.lit("")))).alias("line"), reason.alias("reason"))
    good = rows.where(reason.isNull())
    slug = source_slug(F.coalesce("_source", F.regexp_replace("file", r"\.[^.]*$", "")))
    source = F.concat(F.lit("import-"), F.coalesce(blank_null(slug), F.lit("manual")))
    known = F.array(*[F.lit(a) for names in aliases.values() for a in names])
    values = F.transform(F.arrays_zip(F.col("_names").alias("n"), F.col("_cells").alias("c")), lambda x: F.when(F.array_contains(known, x["n"]), blank_null(F.trim(x["c"]))))
    url = F.coalesce("_url", F.concat(F.lit("import://"), F.col("file"), F.lit("/"), F.col("_tender_number")))
    notices = good.select(
        F.col("_title").alias("title"), url.alias("url"), source.alias("source"), F.col("_tender_number").alias("tender_number"), F.col("_customer").alias("customer"), F.col("_region").alias("region"),
        parse_price("_price", require_currency=False).alias("price"), parse_ts("_deadline").alias("deadline"), F.lit("Актуально").alias("status"), parse_ts("_published_at").alias("published_at"),
        F.coalesce(F.col("_raw_text"), F.array_join(F.array_compact(values), " ")).alias("raw_text"), F.lit("imported").alias("detail_status"), F.lit(0.8).alias("source_confidence"), unique_key(source, "_tender_number", url).alias("unique_key"), F.col("_n").alias("seq"),
    )
    return notices, rejects


def read_cell_grid(grid: DataFrame, roles: Mapping[str, Sequence[str]], required: Sequence[str], most: int = 20, keys: Sequence[str] = ("file", "sheet")) -> DataFrame:
    """Rows below the header of each sheet, a column per role. grid: keys, row, col, value.

    The header is the first of the first `most` rows that holds every required role; a cell
    has the first role of whose words it contains one.
    """
    text = normalize("value")
    role = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)), name) for name, words in roles.items()])
    tagged = grid.where(F.col("row") <= most).withColumn("_role", role).where("_role is not null")
    have = tagged.groupBy(*keys, "row").agg(F.collect_set("_role").alias("_roles"))
    full = have.where(F.size(F.array_intersect("_roles", F.array(*[F.lit(r) for r in required]))) == len(required))
    heads = full.groupBy(*keys).agg(F.min("row").alias("_head"))
    columns = tagged.join(heads, list(keys)).where("row = _head").groupBy(*keys, "_role", "_head").agg(F.min("col").alias("_col"))
    # a row per sheet and role goes to the cells: sheets and columns are few, and as keys of a shuffle they'd part the cells unevenly
    cells = grid.join(F.broadcast(columns.withColumnRenamed("_col", "col")), [*keys, "col"]).where("row > _head")
    return cells.groupBy(*keys, "row").agg(*[F.first(F.when(F.col("_role") == r, F.col("value")), ignorenulls=True).alias(r) for r in roles])


#: Characters of bytes 128 to 255 in the Windows Cyrillic code page, ISO order on the other side.
def _cp1251() -> tuple[str, str]:
    pairs = []
    for b in range(128, 256):
        try:
            pairs.append((bytes([b]).decode("latin-1"), bytes([b]).decode("cp1251")))
        except UnicodeDecodeError:
            continue
    return "".join(a for a, _ in pairs), "".join(c for _, c in pairs)


def decode_text(content: Column) -> Column:
    """Bytes as UTF-8, or as Windows Cyrillic where they are no UTF-8."""
    latin, cyrillic = _cp1251()
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), latin, cyrillic))


def json_values(x: Column) -> Column:
    """All strings, numbers and truth values of a JSON text in their order, with blanks between; names of fields and nulls are left out."""
    tokens = F.regexp_extract_all(x, F.lit(r'"(?:[^"\\]|\\.)*"\s*:?|-?[0-9][-+.0-9eE]*|true|false'), F.lit(0))
    values = F.filter(tokens, lambda t: ~t.rlike(r':$') | ~t.startswith('"'))
    return F.array_join(F.transform(values, lambda t: F.when(t.startswith('"'), F.get_json_object(F.concat(F.lit("["), t, F.lit("]")), "$[0]")).otherwise(t)), " ")


def cell_text(x: Column) -> Column:
    """Cells of a delimited text that hold anything, with blanks between; the more frequent of ; and , delimits, quoted ones don't."""
    count = lambda c: F.length(x) - F.length(F.replace(x, F.lit(c), F.lit("")))
    sep = F.when(count(";") >= count(","), ";").otherwise(",")
    cells = F.flatten(F.transform(F.split(x, r"\r?\n"), lambda line: F.split(line, F.concat(sep, F.lit(r'(?=(?:[^"]*"[^"]*")*[^"]*$)')))))
    plain = F.transform(cells, lambda c: F.replace(F.regexp_replace(c, r'^"|"$', ""), F.lit('""'), F.lit('"')))
    return F.array_join(F.filter(plain, lambda c: c != ""), " ")


def read_documents(spark: SparkSession, root: str, most_bytes: int = 50_000_000) -> DataFrame:
    """doc_id, path, section, sha256, text, error of the files under a folder.

    Texts are those of pages and XML without tags, of delimited files their cells, of JSON
    its values in their order, else the content. Files that are too large, or whose JSON is
    broken, have an error and no text.
    """
    base = root.rstrip("/").split("/")[-1]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.element_at(F.split("path", f"/{base}/", 2), -1)
    large = F.col("length") > most_bytes
    text = decode_text(F.col("content"))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]+>", " "), r"(?U)\s+", " "))
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    broken = (suffix == "json") & F.try_parse_json(text).isNull()
    text = F.when(suffix.isin("html", "htm", "xml"), plain).when(suffix == "json", json_values(text)).when(suffix == "csv", cell_text(text)).otherwise(text)
    section = F.when(F.contains(path, F.lit("/")), F.split_part(path, F.lit("/"), F.lit(1))).otherwise("")
    return raw.select(F.concat(F.lit("kb-"), F.substring(F.sha2(path, 256), 1, 16)).alias("doc_id"), path.alias("path"), section.alias("section"), F.sha2("content", 256).alias("sha256"), F.when(~large & ~broken, text).alias("text"), F.when(large, "too_large").when(broken, "bad_json").alias("error"))


def accept_files(files: DataFrame, suppliers: DataFrame, ledger: DataFrame, most_bytes: int = 25_000_000, suffixes: Sequence[str] = ("xlsx", "xls", "csv", "pdf", "xml", "json", "txt"), indexable: Sequence[str] = ("xlsx", "csv", "xml", "json")) -> DataFrame:
    """Decision per file: too_large, bad_suffix, quarantine (unknown sender), duplicate (same content and supplier), indexed or stored.

    files: file_id, name, size, sha256, sender; suppliers: supplier_id, sender (a rule table, one supplier per sender); ledger: sha256, supplier_id.
    """
    s = suppliers.select(F.lower("sender").alias("_sender"), "supplier_id")
    suffix = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1))
    rows = files.join(s, F.lower("sender") == F.col("_sender"), "left").drop("_sender").withColumn("suffix", suffix)
    old = ledger.select("sha256", "supplier_id").distinct().withColumn("_old", F.lit(True))
    rows = rows.join(old, ["sha256", "supplier_id"], "left")
    first = F.min("file_id").over(_window("sha256", "supplier_id"))
    rows = rows.withColumn("_first", first)
    state = (
        F.when(F.col("size") > most_bytes, "too_large")
        .when(~F.col("suffix").isin(*suffixes), "bad_suffix")
        .when(F.col("supplier_id").isNull(), "quarantine")
        .when(F.col("_old").isNotNull() | (F.col("file_id") != F.col("_first")), "duplicate")
        .when(F.col("suffix").isin(*indexable), "indexed")
        .otherwise("stored")
    )
    return rows.select("file_id", "supplier_id", state.alias("decision"))


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
