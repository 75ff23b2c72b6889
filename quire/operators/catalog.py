"""Packs and catalogs of templates: discovery, lookup, search, archives, manifests."""

from __future__ import annotations

import hashlib
import io
import re
import tarfile
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from quire.functions import templates as T


def first_wins(packs: DataFrame, id: str = "id", order: tuple[str, ...] = ("root", "dir")) -> DataFrame:
    """packs with wins: the first of an id in the search order; the others are problems."""
    return packs.withColumn("wins", F.row_number().over(Window.partitionBy(id).orderBy(*order)) == 1)


def entries(packs: DataFrame) -> DataFrame:
    """A row for each template of each pack, with its address pack:name."""
    return packs.select("*", F.explode("templates").alias("template")).withColumn("address", F.concat_ws(":", "id", "template"))


def resolve(catalog: DataFrame, wanted: DataFrame, address: str = "address", name: str = "template") -> DataFrame:
    """wanted (ask) with hits and address: pack:name by itself; a bare name only if one pack has it."""
    exact = catalog.select(F.col(address).alias("ask"), F.col(address).alias("found"))
    bare = catalog.groupBy(F.col(name).alias("ask")).agg(F.count("*").alias("hits"), F.min(address).alias("found"))
    known = exact.select("ask", F.lit(1).cast("long").alias("hits"), "found").unionByName(bare)
    return wanted.join(known, "ask", "left").select("ask", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.when(F.col("hits") == 1, F.col("found")).alias("found"))


def matches(query: str, texts: tuple[str, ...], tags: str = "tags") -> Column:
    """Whether any text or tag has the query in it, in any case."""
    q = F.lit(query.lower())
    test = F.exists(F.col(tags), lambda t: F.contains(F.lower(t), q))
    for c in texts:
        test = test | F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), q)
    return test


def tagged(catalog: DataFrame, tag: str, tags: str = "tags") -> DataFrame:
    return catalog.where(F.array_contains(tags, tag))


def all_tags(catalog: DataFrame, tags: str = "tags") -> DataFrame:
    return catalog.select(F.explode(tags).alias("tag")).distinct()


def find_version(index: DataFrame, ask: str, order: str = "ord") -> DataFrame:
    """The first entry of id or id@version."""
    id_, _, version = ask.partition("@")
    rows = index.where(F.col("id") == id_)
    if version:
        rows = rows.where(F.col("version") == version)
    return rows.orderBy(order).limit(1)


def find_across(index: DataFrame, asks: DataFrame, ask: str = "ask", order: tuple[str, ...] = ("catalog_no", "ord")) -> DataFrame:
    """ask, catalog, id, version, archive of the first entry of each id or id@version, catalogs in order; versions: all there
    are of the id, for an ask without a hit."""
    wanted = asks.select(ask, F.split_part(ask, F.lit("@"), F.lit(1)).alias("id"), F.split_part(ask, F.lit("@"), F.lit(2)).alias("wanted")).distinct()
    rows = wanted.join(index, "id", "left")
    hit = F.col("version").isNotNull() & ((F.col("wanted") == "") | (F.col("version") == F.col("wanted")))
    entry = F.struct(*order, "catalog", "id", "version", "archive")
    per = rows.groupBy(ask).agg(F.min(F.when(hit, entry)).alias("e"), F.array_sort(F.collect_set("version")).alias("versions"))
    return per.select(ask, "e.catalog", "e.id", "e.version", "e.archive", F.when(F.col("e").isNull(), F.col("versions")).alias("versions"))


def verified(installed: DataFrame, index: DataFrame) -> DataFrame:
    """id, ok: whether an installed pack's bytes have the hash that the catalog says; null if it isn't listed."""
    own = installed.select("id", F.sha2("content", 256).alias("have"))
    listed = index.groupBy("id").agg(F.collect_set("sha256").alias("hashes"))
    return own.join(listed, "id", "left").select("id", F.array_contains("hashes", F.col("have")).alias("ok"))


def counts(index: DataFrame) -> DataFrame:
    return index.groupBy("catalog").agg(F.count("*").alias("packs"))


def listing(catalog: DataFrame, *columns: str) -> DataFrame:
    """One JSON object a row."""
    return catalog.select(F.to_json(F.struct(*columns)).alias("json"))


# Keys a manifest may have.
TOP = frozenset("id name version description authors license tags min_version".split())
TEMPLATE = frozenset("name model file slots description preview".split())
MODELS = ("document", "body")
VARIABLE = frozenset("name required default description".split())


def manifest(text: str) -> tuple[dict, list[str]]:
    """(manifest, problems) of a pack: unknown keys, missing names, bad ids and versions."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as why:
        return {}, [str(why)]
    wrong = [f"unknown key {k!r}" for k in data if k not in TOP | {"template"}]
    for t in data.get("template", []):
        wrong += [f"unknown key template.{k!r}" for k in t if k not in TEMPLATE | {"var"}]
        wrong += [f"unknown key template.var.{k!r}" for v in t.get("var", []) for k in v if k not in VARIABLE]
        wrong += template_problems(t)
    if not re.fullmatch(r"[a-z][a-z0-9-]*(\.[a-z0-9][a-z0-9-]*)+", data.get("id", "")):
        wrong.append(f"bad id {data.get('id', '')!r}")
    if not re.fullmatch(r"(0|[1-9]\d*)(\.(0|[1-9]\d*)){2}([-+][0-9A-Za-z.+-]+)?", data.get("version", ""), re.A):
        wrong.append(f"bad version {data.get('version', '')!r}")
    return data, wrong


def template_problems(entry: dict) -> list[str]:
    """What is wrong with a manifest's template entry, before any file is read."""
    wrong = [f"{key} leaves the pack: {entry.get(key, '')!r}" for key in ("file", "preview") if (key == "file" or key in entry) and not safe(entry.get(key, ""))]
    if "model" in entry and entry["model"] not in MODELS:
        wrong.append(f"model is neither body nor document: {entry['model']!r}")
    if "model" not in entry:
        wrong.append("no model")
    wrong += [f"unknown slot {s!r}" for s in entry.get("slots", []) if s not in (*T.SLOTS, "content", "pager", "glossary")]
    names = [v.get("name", "") for v in entry.get("var", [])]
    wrong += ["a variable without a name"] * names.count("")
    return wrong + [f"variable {n!r} comes twice" for n in dict.fromkeys(names) if n and names.count(n) > 1]


def safe(path: str) -> bool:
    return bool(path) and not re.search(r"\A/|\A[A-Za-z]:|\\|\x00|(?:\A|/)\.\.(?:/|\Z)", path)


def pack(files: dict[str, bytes]) -> bytes:
    """An uncompressed ustar archive, the same for the same files: sorted, without times, owners or odd modes."""
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as tar:
        for name in sorted(files):
            if not safe(name):
                raise ValueError(f"unsafe path {name!r}")
            info = tarfile.TarInfo(name)
            info.size, info.mode, info.mtime = len(files[name]), 0o644, 0
            tar.addfile(info, io.BytesIO(files[name]))
    return out.getvalue()


class ArchiveError(ValueError):
    """An archive that isn't taken, and why."""


BLOCK_SIZE = 512


def _octal(field: bytes, what: str) -> int:
    digits = field.rstrip(b"\0 ").lstrip(b" ")
    if not re.fullmatch(b"[0-7]*", digits):
        raise ArchiveError(f"{what} is no octal number")
    return int(digits or b"0", 8)


def _text(field: bytes, what: str) -> str:
    try:
        return field.split(b"\0", 1)[0].decode()
    except UnicodeDecodeError:
        raise ArchiveError(f"{what} isn't UTF-8") from None


def unpack(data: bytes, most: int = 64 << 20) -> list[tuple[str, int, int, bytes]]:
    """(name, size, mode, content) of each plain file of an uncompressed ustar archive.

    Refused: other dialects, bad checksums and numbers, links, devices, files that can be run, folders with data, odd paths, names
    that come twice, archives that break off, have anything after their end or more than `most` bytes of files."""
    if not data or len(data) % BLOCK_SIZE:
        raise ArchiveError(f"{len(data)} bytes are no whole number of blocks" if data else "the archive is empty")
    found, names, total, at = [], set(), 0, 0
    while True:
        head = data[at : at + BLOCK_SIZE]
        if not head:
            raise ArchiveError("the archive breaks off before its end mark")
        if not any(head):
            if data.count(0, at) != len(data) - at:
                raise ArchiveError("something follows the end mark")
            return found
        if head[257:263] != b"ustar\0" or head[263:265] != b"00":
            raise ArchiveError("no ustar header")
        if sum(head) - sum(head[148:156]) + 8 * 32 != _octal(head[148:156], "checksum"):
            raise ArchiveError("a header's checksum is wrong")
        mode, size, kind = _octal(head[100:108], "mode"), _octal(head[124:136], "size"), head[156:157]
        prefix, name = _text(head[345:500], "prefix"), _text(head[:100], "name")
        path = (f"{prefix}/{name}" if prefix else name).removesuffix("/")
        if not safe(path):
            raise ArchiveError(f"unsafe path {path!r}")
        if path in names:
            raise ArchiveError(f"{path!r} comes twice")
        names.add(path)
        start = at + BLOCK_SIZE
        at = start + -(-size // BLOCK_SIZE) * BLOCK_SIZE
        if at > len(data):
            raise ArchiveError(f"the archive breaks off in {path!r}")
        if kind == b"5":
            if size:
                raise ArchiveError(f"folder {path!r} has data")
            continue
        if kind not in (b"0", b"\0"):
            raise ArchiveError(f"{path!r} is a link" if kind in (b"1", b"2") else f"{path!r} is neither file nor folder")
        if mode & 0o111:
            raise ArchiveError(f"{path!r} can be run")
        total += size
        if total > most:
            raise ArchiveError("archive is too large")
        found.append((path, size, mode, data[start : start + size]))


def untar(archives: DataFrame, key: str = "path", content: str = "content", most: int = 64 << 20) -> DataFrame:
    """key, name, size, mode, data, error: the files of each archive; a bad one has a row with its error."""
    schema = StructType([archives.schema[key], StructField("name", StringType()), StructField("size", LongType()), StructField("mode", IntegerType()), StructField("data", BinaryType()), StructField("error", StringType())])

    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1)):  # one archive at a time
                try:
                    rows = [(k, *f, None) for f in unpack(c.as_py() or b"", most)]
                except ArchiveError as why:
                    rows = [(k, None, None, None, None, str(why))]
                yield pa.RecordBatch.from_pylist([dict(zip((f.name for f in schema), r)) for r in rows], schema=pa.schema([batch.schema.field(0).with_name(key), ("name", pa.string()), ("size", pa.int64()), ("mode", pa.int32()), ("data", pa.binary()), ("error", pa.string())]))

    return archives.select(key, content).mapInArrow(run, schema)


def tarred(files: DataFrame, key: str = "pack") -> DataFrame:
    """key, archive, sha256 from rows (key, name, content); a pack is as small as its files."""
    schema = StructType([files.schema[key], StructField("archive", BinaryType()), StructField("sha256", StringType())])
    together = files.groupBy(key).agg(F.collect_list(F.struct("name", "content")).alias("files"))

    def run(batches):
        for batch in batches:
            made = [pack({f["name"]: f["content"] for f in own}) for own in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array([hashlib.sha256(m).hexdigest() for m in made])], names=[key, "archive", "sha256"])

    return together.mapInArrow(run, schema)


def scaffold(name: str) -> dict[str, str]:
    """The files of a new pack."""
    slug = re.sub("[^a-z0-9]+", "-", name.lower()).strip("-") or "pack"
    ns = T.NAMESPACE
    return {
        "template.toml": f'id = "local.{slug}"\nname = "{name}"\nversion = "0.1.0"\n\n[[template]]\nname = "{slug}"\nmodel = "document"\nfile = "{slug}.html"\n',
        f"{slug}.html": "<!DOCTYPE html>\n<html lang=\"{{%s:lang}}\">\n<head>\n{{%s:head}}</head>\n<body>\n{{%s:content}}</body>\n</html>\n" % (ns, ns, ns),
    }


def grid(catalog: DataFrame, shipped: bool | None = None, tag: str = "", query: str = "", sort: str = "name") -> DataFrame:
    """Entries by three filters, in an order that doesn't depend on how they came."""
    if shipped is not None:
        catalog = catalog.where(F.col("shipped") == shipped)
    if tag:
        catalog = tagged(catalog, tag)
    if query:
        catalog = catalog.where(matches(query, ("name", "id", "description")))
    return catalog.orderBy(F.lower(sort), "id", "name")
