"""Packs and catalogs of templates in folders: found in order, checked, installed, removed."""

from __future__ import annotations

import hashlib
import os
import shutil
import tempfile
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.operators import catalog

PACK = StructType(
    [StructField(n, StringType()) for n in ("id", "name", "version", "description")]
    + [StructField(n, ArrayType(StringType())) for n in ("authors", "tags", "templates", "problems")]
    + [StructField("root", IntegerType()), StructField("dir", StringType())]
)
ENTRY = StructType([StructField(n, StringType()) for n in ("id", "name", "version", "description")] + [StructField("tags", ArrayType(StringType()))] + [StructField(n, StringType()) for n in ("sha256", "archive", "catalog")] + [StructField("ord", IntegerType())])


def discover(spark: SparkSession, roots: list[str]) -> DataFrame:
    """PACK rows of every template.toml one folder below a root, with wins: the first of an id in the order of roots."""
    found = None
    for i, root in enumerate(roots):
        own = spark.read.format("binaryFile").option("pathGlobFilter", "template.toml").option("recursiveFileLookup", "true").load(root).select(F.lit(i).alias("root"), "path", "content")
        found = own if found is None else found.unionByName(own)

    def parse(batches):
        for batch in batches:
            rows = []
            for root, path, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data, wrong = catalog.manifest(content.decode("utf-8", "replace"))
                rows.append({"id": data.get("id", ""), "name": data.get("name", ""), "version": data.get("version", ""), "description": data.get("description"), "authors": data.get("authors", []), "tags": data.get("tags", []), "templates": [t.get("name", "") for t in data.get("template", [])], "problems": wrong, "root": root, "dir": path.rpartition("/")[0]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(n, pa.string()) for n in ("id", "name", "version", "description")] + [(n, pa.list_(pa.string())) for n in ("authors", "tags", "templates", "problems")] + [("root", pa.int32()), ("dir", pa.string())]))

    return catalog.first_wins(found.mapInArrow(parse, PACK))


def index(text: str, where: str) -> tuple[list[dict], list[str]]:
    """(entries, problems) of a catalog.toml."""
    try:
        data = tomllib.loads(text)
    except tomllib.TOMLDecodeError as why:
        return [], [f"{where}: {why}"]
    known = {"id", "name", "version", "description", "authors", "license", "tags", "sha256", "min_version", "archive"}
    wrong, out = [f"{where}: unknown key {k!r}" for k in data if k not in ("pack", "name", "description")], []
    for i, p in enumerate(data.get("pack", [])):
        bad = [f"{where}: unknown key pack.{k!r}" for k in p if k not in known]
        if not catalog.safe(p.get("archive", "")):
            bad.append(f"{where}: archive leaves the catalog: {p.get('archive', '')!r}")
        wrong += bad
        if not bad:
            out.append({k: p.get(k) for k in ("id", "name", "version", "description", "sha256", "archive")} | {"tags": p.get("tags", []), "catalog": where, "ord": i})
    return out, wrong


def catalogs(spark: SparkSession, folders: list[str]) -> tuple[DataFrame, list[str]]:
    """(ENTRY rows of all catalogs in order, problems); one that can't be read is a problem, not a failure."""
    rows, wrong = [], []
    for folder in folders:
        try:
            with open(os.path.join(folder, "catalog.toml"), encoding="utf-8") as f:
                found, bad = index(f.read(), folder)
        except OSError as why:
            found, bad = [], [str(why)]
        rows += found
        wrong += bad
    return spark.createDataFrame([tuple(r.get(f.name) for f in ENTRY) for r in rows], ENTRY), wrong


def folder_files(path: str) -> dict[str, bytes]:
    """The plain files of a folder; links and files that can be run are refused."""
    found = {}
    for top, _, names in os.walk(path):
        for n in names:
            full = os.path.join(top, n)
            if os.path.islink(full):
                raise ValueError(f"link in a pack: {n}")
            if os.access(full, os.X_OK):
                raise ValueError(f"executable in a pack: {n}")
            with open(full, "rb") as f:
                found[os.path.relpath(full, path).replace(os.sep, "/")] = f.read()
    return found


def check(files: dict[str, bytes]) -> list[str]:
    """Problems of a pack's files: its manifest, its templates, variables that nothing uses."""
    if "template.toml" not in files:
        return ["no template.toml"]
    data, wrong = catalog.manifest(files["template.toml"].decode("utf-8", "replace"))
    for t in data.get("template", []):
        html = files.get(t.get("file", ""), b"").decode("utf-8", "replace")
        if not html:
            wrong.append(f"no file {t.get('file')!r}")
        elif "{{quire:content}}" not in html:
            wrong.append(f"{t.get('file')!r} has no content slot")
        wrong += [f"variable {v.get('name')!r} is not used" for v in t.get("var", []) if "{{quire:var:%s}}" % v.get("name") not in html]
    return wrong


def install(files: dict[str, bytes], root: str, sha256: str | None = None, archive: bytes | None = None) -> str:
    """The pack's folder below root. All is checked and written beside its place first; the last step is a rename."""
    if sha256 is not None and hashlib.sha256(archive or b"").hexdigest() != sha256:
        raise ValueError("the archive isn't the one that the catalog names")
    if wrong := check(files):
        raise ValueError("; ".join(wrong))
    name = tomllib.loads(files["template.toml"].decode())["id"]
    os.makedirs(root, exist_ok=True)
    staged = tempfile.mkdtemp(prefix=".staged-", dir=root)
    try:
        for path, content in files.items():
            full = os.path.join(staged, path)
            os.makedirs(os.path.dirname(full), exist_ok=True)
            with open(full, "wb") as f:
                f.write(content)
        os.rename(staged, target := os.path.join(root, name))
    except OSError:
        shutil.rmtree(staged, ignore_errors=True)
        raise
    return target


def install_archive(data: bytes, root: str, sha256: str | None = None) -> str:
    return install({name: content for name, _, _, content in catalog.unpack(data)}, root, sha256, data)


def remove(root: str, name: str) -> None:
    """A pack's folder, which must be one."""
    target = os.path.join(root, name)
    if not catalog.safe(name) or not os.path.isfile(os.path.join(target, "template.toml")):
        raise ValueError(f"no pack {name!r} in {root}")
    shutil.rmtree(target)
