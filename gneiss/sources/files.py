"""Repository files as tables: listing, texts, manifests, assets, vendored libraries, and the parse cache."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import basename, extension
from gneiss.functions.windows import top_per
from gneiss.plans.config import Config, NotAFolder, PathMissing, TooManyFiles

BUNDLES = r"\.(xcassets|bundle|app|appex|xctestplan)$"
# fixed values: media types
MEDIA = (
    "png", "jpg", "jpeg", "pdf", "svg", "heic", "webp", "gif", "jxl", "mp3", "wav", "aac", "m4a", "ogg", "flac", "caf", "aiff", "mp4", "mov", "m4v", "avi", "mkv",
)
HEAVY_BYTES = 102_400


def listing(spark: SparkSession, root: str) -> DataFrame:
    """rel_path, path, size_bytes, modified of every file that isn't hidden, from any store Spark reads."""
    base = root.rstrip("/")
    if "://" not in base:
        if not os.path.exists(base):
            raise PathMissing(base)
        if not os.path.isdir(base):
            raise NotAFolder(base)
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    place = F.regexp_replace("path", "^file:/+", "/")
    prefix = base if "://" in base and not base.startswith("file:") else "/" + base.removeprefix("file:").lstrip("/") if base.startswith(("/", "file:")) else os.path.abspath(base)
    return df.select(F.substring(place, F.lit(len(prefix) + 2), F.length(place)).alias("rel_path"), "path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))


def kept(rel_path: Column, exclude: list[str]) -> Column:
    """Whether no folder above a file is excluded or a bundle."""
    folders = F.slice(F.split(rel_path, "/"), F.lit(1), F.size(F.split(rel_path, "/")) - 1)
    return ~F.exists(folders, lambda c: c.isin(*exclude) | c.rlike(BUNDLES))


def texts(spark: SparkSession, root: str, wanted: Column, exclude: list[str]) -> DataFrame:
    """file_path (relative) and text of the wanted files; wanted is a condition over rel_path."""
    listed = listing(spark, root).select("rel_path", "path").filter(kept(F.col("rel_path"), exclude) & wanted)
    content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root.rstrip("/")).select("path", "content")
    return content.join(listed, "path").select(F.col("rel_path").alias("file_path"), F.decode("content", "UTF-8").alias("text"))


def sources(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """The source files; a mixed project has Objective-C files too. Too many files are an error."""
    listed = listing(spark, root).filter(kept(F.col("rel_path"), config.exclude))
    extensions = ["swift", "h", "m", "mm"] if is_mixed(listed) else config.extensions
    wanted = extension(F.col("rel_path")).isin(*extensions)
    n = listed.filter(wanted).count()
    if n > config.max_files:
        raise TooManyFiles(f"{n} files, at most {config.max_files}")
    return texts(spark, root, wanted, config.exclude)


def is_mixed(listed: DataFrame) -> bool:
    """Whether there is an Objective-C file; a lone header is none."""
    return not listed.filter(extension(F.col("rel_path")).isin("m", "mm")).isEmpty()


def bridging_header(project: DataFrame) -> DataFrame:
    """The bridging header that the project file names, relative to the root."""
    name = F.trim(F.regexp_extract("text", r'SWIFT_OBJC_BRIDGING_HEADER\s*=\s*"?([^";]+)"?', 1))
    rows = project.filter(F.col("file_path").rlike(r"^[^/]+\.xcodeproj/project\.pbxproj$") & (name != ""))
    return rows.orderBy("file_path").limit(1).select(F.regexp_replace(name, r"^\$\((SRCROOT|PROJECT_DIR)\)/", "").alias("header"))


def project_texts(spark: SparkSession, root: str, exclude: list[str]) -> DataFrame:
    """Plists, build settings and manifests; .env files too, where the root is a local folder."""
    name = basename(F.col("rel_path"))
    wanted = extension(F.col("rel_path")).isin("plist", "xcconfig", "pbxproj") | name.isin("Package.swift", "Project.swift")
    out = texts(spark, root, wanted, exclude)
    if "://" in root:
        return out
    hidden = []
    for folder, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in exclude and d != ".git"]
        hidden += [(os.path.relpath(os.path.join(folder, n), root), Path(folder, n).read_text(errors="replace")) for n in names if n.startswith(".env") or n == ".bazelrc"]
    return out.unionByName(spark.createDataFrame(hidden, "file_path string, text string"))


def with_ext(listed: DataFrame) -> DataFrame:
    return listed.withColumn("ext", extension(F.col("rel_path")))


def assets(listed: DataFrame) -> DataFrame:
    """rel_path, ext and size of media files."""
    return with_ext(listed).filter(F.col("ext").isin(*MEDIA)).select("rel_path", "ext", "size_bytes")


def heavy_types(listed: DataFrame) -> DataFrame:
    """Types of large files in asset catalogues that aren't media."""
    some = with_ext(listed).filter(F.col("rel_path").rlike(r"(^|/)[^/]+\.xcassets/") & ~F.col("ext").isin(*MEDIA) & (F.col("size_bytes") > HEAVY_BYTES))
    return some.select("ext").distinct()


def shaders(listed: DataFrame, exclude: list[str]) -> DataFrame:
    """Metal shaders and the package they lie in."""
    package = F.coalesce(F.nullif(F.regexp_extract("rel_path", r"(?:^|/)Packages/([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract("rel_path", r"([^/]+)/Sources/", 1), F.lit("")), F.lit(""))
    return listed.filter(F.col("rel_path").endswith(".metal") & kept(F.col("rel_path"), exclude)).select("rel_path", package.alias("package"), "size_bytes")


def vendored(listed: DataFrame, libraries: DataFrame, least: int = 2) -> DataFrame:
    """Folders named like a known library (name) that hold enough source files: name, path, file_count, est_lines."""
    source = with_ext(listed).filter(F.col("ext").isin("swift", "h", "m", "mm", "c", "cc", "cpp", "cxx", "hpp", "hxx"))
    parts = F.split("rel_path", "/")
    n = F.size(parts) - 1
    folders = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.lower(F.element_at(parts, i)).alias("name"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("dir"))))
    each = source.select("size_bytes", F.explode(folders).alias("f")).select("size_bytes", "f.name", "f.dir")
    found = each.join(libraries.select(F.lower("name").alias("name")).distinct(), "name").groupBy("name", "dir").agg(F.count("*").alias("file_count"), F.sum(F.floor(F.col("size_bytes") / 40)).alias("est_lines"))
    return top_per(found.filter(F.col("file_count") >= least), ["name"], [F.length("dir"), F.col("dir")], 1).withColumnRenamed("dir", "path")


#: A few libraries that are often copied into repositories; pass an own table for more.
LIBRARIES = (
    "ffmpeg", "opus", "ogg", "webrtc", "libvpx", "openh264", "dav1d", "flac", "thorvg", "rlottie", "skia", "cairo", "harfbuzz", "freetype", "libpng", "libjpeg",
    "libwebp", "giflib", "imgui", "stb", "mozjpeg", "zlib", "lz4", "zstd", "brotli", "snappy", "lzma", "minizip", "openssl", "boringssl", "libsodium", "mbedtls",
    "curl", "nghttp2", "libuv", "nanopb", "protobuf", "rapidjson", "cjson", "yyjson", "flatbuffers", "msgpack", "sqlite3", "sqlcipher", "eigen", "opencv",
    "whisper.cpp", "llama.cpp", "ggml", "icu", "pcre2", "leveldb", "rocksdb", "lmdb", "realm-core", "lua", "quickjs", "hermes", "wasm3", "libffi", "jemalloc",
    "abseil-cpp", "breakpad", "portaudio", "libxml2", "expat", "boost", "fmt", "spdlog", "libyuv", "xxhash", "alamofire", "moya", "afnetworking", "starscream",
    "rxswift", "promisekit", "sdwebimage", "kingfisher", "nuke", "realm", "fmdb", "grdb", "mmkv", "swiftyjson", "objectmapper", "charts", "lottie-ios", "hero",
    "snapkit", "masonry", "swinject", "quick", "nimble", "cryptoswift", "firebase", "reachability", "keychainaccess", "zipfoundation",
)


# project metadata

VERSIONS = (  # fixed values: features that a language version brought
    ("6.0", r"throws\s*\(\s*\w+|@Test|nonisolated\(unsafe\)"),
    ("5.9", r"@Observable|#Predicate|#Preview"),
    ("5.7", r"if\s+let\s+\w+\s*\{|ContinuousClock|SuspendingClock"),
    ("5.5", r"\basync\b|\bawait\b|(?<![a-zA-Z0-9_])actor\s+[A-Z]|@MainActor"),
    ("5.3", r"@main"),
    ("5.1", r"some |@State|@Published|@Binding"),
)
TARGETS = (("IPHONEOS", "iOS"), ("MACOSX", "macOS"), ("TVOS", "tvOS"), ("WATCHOS", "watchOS"))


def language_version(files: DataFrame, most: int | None = None) -> DataFrame:
    """One row: the highest version whose features the code uses, with a plus; '' for none. most: of the first so many files only."""
    some = files.filter("file_path LIKE '%.swift' AND file_path NOT LIKE '%/Tests/%'")
    some = some if most is None else some.orderBy("file_path").limit(most)
    version = None
    for v, pattern in VERSIONS:
        version = F.when(F.col("text").rlike(pattern), v) if version is None else version.when(F.col("text").rlike(pattern), v)
    return some.agg(F.coalesce(F.concat(F.max(version), F.lit("+")), F.lit("")).alias("version"))


def metadata(project: DataFrame, files: DataFrame, version_files: int | None = None) -> DataFrame:
    """One row: language version, deployment targets and app version, each from the first source that has it."""
    text, path = F.col("text"), F.col("file_path")
    root_manifest, pbx = path == "Package.swift", path.rlike(r"^[^/]+\.xcodeproj/project\.pbxproj$")
    pick = lambda cond, pattern: F.min(F.when(cond & (F.regexp_extract(text, pattern, 1) != ""), F.struct(path.alias("p"), F.regexp_extract(text, pattern, 1).alias("v"))))["v"]
    platforms = F.regexp_extract_all(F.regexp_extract(text, r"platforms:\s*\[([^\]]+)\]", 1), F.lit(r"\.((?:iOS|macOS|tvOS|watchOS|visionOS)\(\.v[\w._]+\))"), F.lit(1))
    platforms = F.transform(platforms, lambda s: F.replace(F.regexp_replace(s, r"\(\.v([\w._]+)\)", " $1"), F.lit("_"), F.lit(".")))
    by_project = F.filter(F.array(*(F.when(F.regexp_extract(text, rf"{k}_DEPLOYMENT_TARGET\s*=\s*([\d.]+)", 1) != "", F.concat(F.lit(n + " "), F.regexp_extract(text, rf"{k}_DEPLOYMENT_TARGET\s*=\s*([\d.]+)", 1))) for k, n in TARGETS)), lambda x: x.isNotNull())
    plist = path.isin("Info.plist", "Support/Info.plist", "Resources/Info.plist")
    short = r"CFBundleShortVersionString</key>\s*<string>([^<]+)</string>"
    row = project.agg(
        pick(root_manifest, r"swift-tools-version:\s*([\d.]+)").alias("tools"), pick(pbx, r"SWIFT_VERSION\s*=\s*([\d.]+)").alias("setting"),
        F.min(F.when(root_manifest & (F.size(platforms) > 0), platforms)).alias("platforms"), F.min(F.when(pbx & (F.size(by_project) > 0), by_project)).alias("settings"),
        F.coalesce(pick(pbx, r"MARKETING_VERSION\s*=\s*([\d.]+)"), pick(path == ".bazelrc", r"(?i)version\s*=\s*([\d.]+)"), pick(path == "Project.swift", r"""CFBundleShortVersionString["':\s]+([\d.]+)"""), pick(plist, short)).alias("app_version"),
    )
    both = row.join(language_version(files, version_files))
    return both.select(F.coalesce("tools", "setting", "version").alias("language_version"), F.coalesce("platforms", "settings", F.array().cast("array<string>")).alias("targets"), F.coalesce("app_version", F.lit("")).alias("app_version"))


# parse cache

SCHEMA_VERSION = "1"


def cached(listed: DataFrame, files: DataFrame, parse, path: str) -> DataFrame:
    """parse(files), with rows kept in a Parquet table by a key of path, time, size, content and schema; only misses are parsed.

    Rows of files that changed or are gone don't come back: the kept table is joined with the keys of now.
    """
    spark = files.sparkSession
    at = listed.select(F.col("rel_path").alias("file_path"), "modified", "size_bytes")
    seen = files.join(at, "file_path").select("file_path", F.md5(F.concat_ws(":", "file_path", F.col("modified").cast("string"), F.col("size_bytes").cast("string"), F.md5("text"), F.lit(SCHEMA_VERSION))).alias("key"))
    try:
        stored = spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    missing = seen if stored is None else seen.join(stored.select("key"), "key", "left_anti")
    fresh = parse(files.join(missing.select("file_path"), "file_path", "left_semi")).join(missing, "file_path")
    fresh.write.mode("append").parquet(path)
    return spark.read.parquet(path).join(seen.select("key"), "key", "left_semi").dropDuplicates(["key"]).drop("key")
