"""File sources: corpus scan, decoding, format dispatch, sectioned notes, cards."""

from __future__ import annotations

import base64
import json
import struct
import zlib

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Extensions and decoders.
EXTENSIONS = (".pdf", ".md", ".txt")
#: Decoders that are tried in order; the first that fits wins, so a byte order mark stays in UTF-8 text.
DECODERS = ("utf-8", "utf-8-sig", "gb18030", "big5")
COUNTING_DECODERS = ("utf-8", "gb18030", "gbk", "latin-1")
CODE = (".py", ".js", ".ts", ".java", ".c", ".cpp", ".go", ".rs", ".json", ".yaml", ".yml", ".toml", ".html", ".css", ".sh", ".sql", ".tex", ".rst")


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """SRC-01, AGG-05: (files with path, ext, length, content; skipped files by extension). Hidden names are not read."""
    every = routed(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder), extensions)
    return every.filter("supported").select("path", "ext", "length", "content"), by_extension(every.filter("NOT supported")).drop("supported")


def routed(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """Files (path, ...) without hidden names, with ext in lower case and whether it is supported."""
    out = files.withColumn("ext", F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))).filter(~F.col("path").rlike(r"/\.[^/]*(?:/|$)"))
    return out.withColumn("supported", F.col("ext").isin(*extensions))


def by_extension(files: DataFrame) -> DataFrame:
    """AGG-05."""
    return files.groupBy("ext", "supported").agg(F.count("*").alias("n"))


def accepted(files: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """SRC-13: (uploads within the limits, rejected ones with the reason)."""
    reason = F.when(~F.col("ext").isin(*EXTENSIONS), "type").when(F.col("length") == 0, "empty").when(F.col("length") > most, "size")
    r = files.withColumn("reason", reason)
    return r.filter("reason IS NULL").drop("reason"), r.filter("reason IS NOT NULL")


def decoded(content: Column, decoders: tuple[str, ...] = DECODERS) -> Column:
    """SRC-02: the text by the first decoder that fits; null if none does."""

    @F.pandas_udf("string")
    def decode(raw: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            for name in decoders if b is not None else ():
                try:
                    return bytes(b).decode(name)
                except UnicodeDecodeError:
                    continue
            return None

        return raw.map(one)

    return decode(content)


def text_chars(content: Column) -> Column:
    """SRC-03: characters that are no white space."""
    return F.coalesce(F.length(F.regexp_replace(decoded(content, COUNTING_DECODERS), r"(?U)\s+", "")), F.lit(0))


def reader(ext: Column) -> Column:
    """SRC-04: pdf, markdown, code, text or, for anything else, text to be tried."""
    return F.when(ext == ".pdf", "pdf").when(ext.isin(".md", ".markdown"), "markdown").when(ext.isin(*CODE), "code").when(ext.isin(".txt", ".csv"), "text").otherwise("try text")


def pages_of(files: DataFrame, extract, schema: str = "path string, page int, text string") -> DataFrame:
    """SRC-05: pages by an injected ``extract(bytes) -> list of texts``; a file without text gives one page of null."""

    def run(batches):
        for b in batches:
            rows = [(p, i + 1, t) for p, c in zip(b["path"], b["content"]) for i, t in enumerate(extract(bytes(c)) or [None])]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, schema)


def cascade(files: DataFrame, extractors: list) -> DataFrame:
    """SRC-05: (path, page, text, reader, warning) by the first of the injected extractors, functions of bytes to a list of
    pages' texts, that finds text; one that raises counts as one that finds none. A file of which no one finds any has
    a row without text and a warning."""

    def run(batches):
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"]):
                for i, extract in enumerate(extractors):
                    try:
                        pages = extract(bytes(content))
                    except Exception:  # noqa: BLE001  the next reader may do better
                        continue
                    if any(t and t.strip() for t in pages):
                        rows += [(path, n, t, i, None) for n, t in enumerate(pages, 1)]
                        break
                else:
                    rows.append((path, None, None, None, "no_text_extracted"))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "reader", "warning"]).astype({"page": "Int32", "reader": "Int32"})

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string, reader int, warning string")


def collection(spark: SparkSession, path: str, name: str, most: int | None = None) -> DataFrame:
    """SRC-06: the chunks (id, ...) of a collection; other collections' folders are not read. With ``most`` the first by id."""
    rows = spark.read.parquet(path).filter(F.col("collection") == name)
    return rows.orderBy("id").limit(most) if most is not None else rows


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """SRC-08: entities and relations of a graph in JSON; None if it is missing or malformed."""
    schema = "entities map<string,struct<name:string,type:string,freq:long>>, relations array<struct<h:string,r:string,t:string,w:long,e:string>>, broken string"
    try:
        found = spark.read.option("multiLine", True).option("columnNameOfCorruptRecord", "broken").schema(schema).json(path)
        if found.filter("broken IS NOT NULL OR entities IS NULL OR relations IS NULL").limit(1).count() or not found.limit(1).count():
            return None
    except AnalysisException:
        return None
    ents = found.select(F.explode("entities").alias("key", "e")).select("key", "e.*")
    return ents, found.select(F.explode("relations").alias("e")).select("e.*")


def note(text: str) -> dict:
    """SRC-10: the front matter's fields and the sections of a note."""
    head, body = {}, text or ""
    lines = body.split("\n")
    if lines[0].strip() == "---" and any(x.strip() == "---" for x in lines[1:]):
        end = next(i for i, x in enumerate(lines[1:], 1) if x.strip() == "---")
        for line in lines[1:end]:
            k, sep, v = line.partition(":")
            if sep and k.strip():
                head[k.strip()] = v.strip().strip("\"'")
        body = "\n".join(lines[end + 1 :])
    sections, name, held = {}, "", []
    for line in [*body.split("\n"), "## "]:
        if line.startswith("## "):
            if name or "".join(held).strip():
                sections[name] = "\n".join(held).strip()
            name, held = line[3:].strip(), []
        else:
            held.append(line)
    return {"head": head, "sections": sections}


def notes(texts: Column) -> Column:
    @F.pandas_udf("head map<string,string>, sections map<string,string>")
    def parse(t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([note(x) for x in t], columns=["head", "sections"])

    return parse(texts)


def lorebook(block: str) -> list[dict]:
    """MIS-02: entries 'keyword: content', split at the first colon of either width; indented lines go on; or a JSON list."""
    stripped = (block or "").strip()
    if stripped.startswith("["):
        try:
            found = json.loads(stripped)
            return [{"keyword": str(e["keyword"]).strip(), "content": str(e["content"]).strip()} for e in found if isinstance(e, dict) and e.get("keyword") and e.get("content")]
        except json.JSONDecodeError:
            return []
    out: list[dict] = []
    for line in (block or "").split("\n"):
        if not line.strip():
            continue
        if line[0] in " \t" and out:
            out[-1]["content"] += "\n" + line.strip()
            continue
        at = min((i for i in (line.find(":"), line.find("：")) if i >= 0), default=-1)
        if at > 0:
            out.append({"keyword": line[:at].lstrip("-* ").strip(), "content": line[at + 1 :].strip()})
    return [e for e in out if e["keyword"] and e["content"]]


def png_text(data: bytes, key: str) -> str | None:
    """SRC-11: the text of a tEXt or zTXt chunk of a PNG."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        return None
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        name, _, rest = body.partition(b"\0")
        if kind in (b"tEXt", b"zTXt") and name.decode("latin-1") == key:
            return (rest if kind == b"tEXt" else zlib.decompress(rest[1:])).decode("latin-1")
        at += 12 + n
    return None


def card(data: bytes, key: str = "chara") -> dict | None:
    """SRC-11, MIS-03: the card in a PNG; null if there is none or it has no name, or neither role nor background."""
    raw = png_text(data, key)
    try:
        c = json.loads(base64.b64decode(raw)) if raw else None
    except ValueError:
        return None
    c = c.get("data", c) if isinstance(c, dict) else None
    if not c or not str(c.get("name", "")).strip() or not (c.get("role") or c.get("background") or c.get("description")):
        return None
    book = [e for e in c.get("lorebook", []) if isinstance(e, dict) and e.get("keyword") and e.get("content")]
    return {"name": c["name"].strip(), "role": c.get("role", ""), "background": c.get("background") or c.get("description", ""), "lorebook": [{"keyword": e["keyword"], "content": e["content"]} for e in book]}


def cards(files: DataFrame, key: str = "chara") -> DataFrame:
    @F.pandas_udf("string")
    def parse(raw: pd.Series) -> pd.Series:
        return raw.map(lambda b: json.dumps(c) if (c := card(bytes(b), key)) else None)

    schema = "name string, role string, background string, lorebook array<struct<keyword:string,content:string>>"
    return files.select("path", F.from_json(parse("content"), schema).alias("card"))
