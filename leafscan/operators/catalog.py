"""Extension catalogs, file manifests and dependency audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Libraries every base system has.
BASE_LIBRARIES = (
    "kernel32.dll", "kernelbase.dll", "ntdll.dll", "user32.dll", "gdi32.dll", "advapi32.dll", "shell32.dll", "shlwapi.dll", "ole32.dll", "oleaut32.dll", "combase.dll", "rpcrt4.dll",
    "ucrtbase.dll", "msvcrt.dll", "vcruntime140.dll", "vcruntime140_1.dll", "ws2_32.dll", "mswsock.dll", "dnsapi.dll", "iphlpapi.dll", "secur32.dll", "sechost.dll",
    "bcrypt.dll", "bcryptprimitives.dll", "ncrypt.dll", "crypt32.dll", "cryptbase.dll", "wintrust.dll", "userenv.dll", "version.dll", "psapi.dll", "dbghelp.dll", "imagehlp.dll", "rpcns4.dll",
    "comctl32.dll", "comdlg32.dll", "imm32.dll", "winmm.dll", "setupapi.dll", "cfgmgr32.dll", "powrprof.dll", "mpr.dll", "netapi32.dll", "wtsapi32.dll", "avrt.dll", "gdiplus.dll",
    "uxtheme.dll", "dwmapi.dll", "propsys.dll", "hid.dll", "pdh.dll", "msi.dll", "normaliz.dll", "d3d11.dll", "dxgi.dll", "opengl32.dll", "usp10.dll", "dwrite.dll", "wldap32.dll", "winhttp.dll",
    "wininet.dll", "cabinet.dll", "msvcp140.dll", "msvcp140_1.dll", "msvcp140_2.dll", "concrt140.dll",
)
#: Libraries a system has only if something was installed.
CONDITIONAL_LIBRARIES = ("vcruntime140_threads.dll", "msvcp140.dll", "msvcp140_atomic_wait.dll", "mfplat.dll", "mf.dll", "mfreadwrite.dll", "cudart64_12.dll")
#: Prefixes of library names that the system resolves.
SYSTEM_PREFIXES = ("api-ms-win", "ext-ms-win")
#: Packages that a runtime leaves out.
SKIPPED_PACKAGES = "(?i)^(?:torch|torchgen|torchsummary|torchvision|functorch|transformers|tokenizers|unidic_lite|fugashi|comic_text_detector|manga_ocr|mokuro|onnxruntime)(?:$|[-_.])"


def upsert(old: DataFrame, new: DataFrame, key: str = "id", order: str = "seq", keep_unknown: bool = False) -> DataFrame:
    """Entries of ``old`` without those of ``new``'s keys, then ``new``; ``place`` is the order from 0.

    ``keep_unknown``: columns that ``new`` lacks keep their old values; else they are lost (null).
    """
    from pyspark.sql import Window

    first = old.join(new.select(key), key, "left_anti").withColumn("__side", F.lit(0))
    last = new.withColumn("__side", F.lit(1))
    if keep_unknown and (extra := [c for c in old.columns if c not in new.columns]):
        last = last.join(old.select(key, *extra), key, "left")
    both = first.unionByName(last, allowMissingColumns=True)
    # sides are numbered apart, so that only counts meet in one task
    numbered = both.withColumn("__n", F.row_number().over(Window.partitionBy("__side").orderBy(order)))
    before = first.agg(F.count("*").alias("__before"))
    place = F.col("__n") - 1 + F.when(F.col("__side") == 1, F.col("__before")).otherwise(F.lit(0))
    return numbered.crossJoin(F.broadcast(before)).withColumn("place", place.cast("long")).drop("__side", "__n", "__before")


def merged_assets(old: Column, new: Column, same_version: Column) -> Column:
    """New assets over the old ones, which count only for the same version."""
    kept = F.map_filter(F.when(same_version, old).otherwise(F.map_filter(old, lambda k, v: F.lit(False))), lambda k, v: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest entries (name, sha256) with ``status``: ok, changed or missing; files: name, content."""
    actual = files.select("name", F.sha2(F.col("content").cast("binary"), 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ok").otherwise("changed")
    return manifest.join(actual, "name", "left").withColumn("status", status)


def require_verified(files: DataFrame, manifest: DataFrame) -> None:
    bad = verified(files, manifest).where("status <> 'ok'").orderBy("name").first()
    if bad:
        raise ValueError(f"{bad['name']}: {bad['status']}")


def require_known(wanted: DataFrame, known: DataFrame, key: str) -> None:
    """An error for a key that is not among the known ones."""
    bad = wanted.join(known, key, "left_anti").first()
    if bad:
        raise ValueError(f"unknown {key}: {bad[key]}")


def kept_packages(packages: DataFrame, name: str = "name") -> DataFrame:
    return packages.where(~F.col(name).rlike(SKIPPED_PACKAGES))


def missing_libraries(imports: DataFrame, provided: DataFrame) -> DataFrame:
    """(lib, kind, users): imported libraries that neither the package nor a base system has; kind hard or conditional.

    imports: file, lib; provided: lib.  A library on both fixed lists is conditional.
    """
    system = F.lit(False)
    for prefix in SYSTEM_PREFIXES:
        system = system | F.startswith("lib", F.lit(prefix))
    conditional = F.col("lib").isin(*CONDITIONAL_LIBRARIES)
    left = imports.withColumn("lib", F.lower("lib")).join(provided.select(F.lower("lib").alias("lib")), "lib", "left_anti").where(~system & (conditional | ~F.col("lib").isin(*BASE_LIBRARIES)))
    return left.groupBy("lib").agg(F.when(F.first(conditional), "conditional").otherwise("hard").alias("kind"), F.countDistinct("file").alias("users"))


def library_users(imports: DataFrame) -> DataFrame:
    """(lib, files, users): each imported library, the sorted set of files that name it; most used first."""
    found = imports.groupBy(F.lower("lib").alias("lib")).agg(F.sort_array(F.collect_set("file")).alias("files"))
    return found.withColumn("users", F.size("files").cast("long")).orderBy(F.col("users").desc(), "lib")


def total_bytes(files: DataFrame, *keys: str, size: str = "bytes") -> DataFrame:
    """Files and their summed size, by ``keys``."""
    return files.groupBy(*keys).agg(F.count("*").alias("files"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"))


def checksums(files: DataFrame, name: str = "name", content: str = "content") -> DataFrame:
    """(name, crc32) of files' contents."""
    return files.select(name, F.crc32(F.col(content).cast("binary")).alias("crc32"))


def missing_packages(wanted: DataFrame, present: DataFrame, name: str = "name") -> DataFrame:
    """Wanted packages that are not present; names are compared in lower case, with ``_`` for ``-``."""
    plain = F.replace(F.lower(name), F.lit("-"), F.lit("_"))
    return wanted.withColumn("__n", plain).join(present.select(plain.alias("__n")), "__n", "left_anti").select(*wanted.columns)


def require_packages(wanted: DataFrame, present: DataFrame, name: str = "name") -> None:
    """An error that names the first wanted package that is not present."""
    bad = missing_packages(wanted, present, name).orderBy(name).first()
    if bad:
        raise ValueError(f"package {bad[name]} is missing")


def entry_json(entries: DataFrame, key: str = "id", pretty: bool = True) -> DataFrame:
    """(key, entry): each row as a JSON object, nulls left out."""
    options = {"pretty": "true"} if pretty else {}
    return entries.select(key, F.to_json(F.struct(*entries.columns), options).alias("entry"))


def audit_fails(missing: DataFrame, strict: bool = False) -> DataFrame:
    """One row: whether the audit fails."""
    return missing.agg((F.count_if(F.col("kind") == "hard") > 0).alias("hard"), (F.count_if(F.col("kind") == "conditional") > 0).alias("c")).select((F.col("hard") | (F.lit(strict) & F.col("c"))).alias("fail"))


def blanked(sha256: Column, target: Column, host: str, override: bool = False) -> Column:
    """Hashes of builds for another target are left empty."""
    return sha256 if override else F.when(target == host, sha256).otherwise(F.lit(""))
