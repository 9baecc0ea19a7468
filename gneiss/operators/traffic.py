"""Network traffic in source lines: routes and listeners inbound, urls and sockets outbound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.text import basename, extension, trim
from gneiss.functions.windows import examples_per, top_per

# fixed values: files that hold no runtime connections
SKIP_NAMES = ("Package.swift", "Package.resolved", "Project.swift", "Podfile")
SKIP_EXTENSIONS = ("h", "hpp", "hh", "hxx")
SKIP_ENDS = ("Tests.swift", "Test.swift", "Spec.swift", "Specs.swift", "TestCase.swift", "UITests.swift")
SKIP_PARTS = ("/Tests/", "/Test/", "/Specs/", "/Spec/", "/UITests/", "/UnitTests/", "/IntegrationTests/", "/TestHelpers/", "/Fixtures/", "/Mocks/", "/Stubs/", "/ProjectSpec/")
ROUTE = r"(?i)(?:app|routes|router|grouped)\.(?:get|post|put|patch|delete|on)\("
URL = r'"((?:https?|wss?)://[^"]*)"'
SOCKETS = (("NWConnection(", "NWConnection", True), ("NWPathMonitor(", "NWPathMonitor", False), ("SCNetworkReachabilityCreateWith", "SCNetworkReachability", False), ("CFStreamCreatePairWithSocketToHost", "CFStream", True))


def scanned(path: Column) -> Column:
    """Whether a file may hold runtime connections."""
    name = basename(path)
    out = ~name.isin(*SKIP_NAMES) & ~extension(path).isin(*SKIP_EXTENSIONS)
    for e in SKIP_ENDS:
        out = out & ~name.endswith(e)
    for p in SKIP_PARTS:
        out = out & ~path.contains(p)
    return out


def commented(lines: DataFrame) -> DataFrame:
    """lines (file_path, line_no, raw) outside comments, by whole lines: a block opens and closes at line starts and ends."""
    from pyspark.sql import Window

    t = trim(F.col("raw"))
    w = Window.partitionBy("file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    opens, closes = t.startswith("/*") & ~t.contains("*/"), t.contains("*/")
    # the last line before this one that opens or closes a block
    mark = F.last(F.when(opens, F.lit(1)).when(closes, F.lit(0)), ignorenulls=True).over(w)
    return lines.withColumn("t", t).withColumn("inside", F.coalesce(mark, F.lit(0)) == 1).filter(~F.col("inside") & ~t.startswith("/*") & ~t.startswith("//") & ~t.startswith("*")).drop("inside")


def port_in(line: Column) -> Column:
    """The port a line names, '' if none is valid."""
    found = F.regexp_extract(line, r"(?:rawValue:|NWEndpoint\.Port\(|port:| on:)[ \t]*([0-9]+)", 1)
    return F.when((F.length(found) < 6) & found.rlike("^[0-9]+$") & (found.try_cast("int").between(1, 65535)), found).otherwise("")


def literal_in(line: Column) -> Column:
    return F.regexp_extract(line, '"([^"]*)"', 1)


def protocol(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.contains("grpc"), "gRPC").when(low.contains("graphql"), "GraphQL").when(low.contains("websocket"), "WebSocket").otherwise("REST")


def data_format(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.contains("protobuf") | low.contains(".proto"), "Protobuf").when(low.contains("xml"), "XML").when(low.rlike("json|codable|decodable"), "JSON").otherwise("")


def entries(files: DataFrame) -> DataFrame:
    """direction, uri, port, proto, data_fmt, file_path, line, module of each first (uri, proto, module).

    files: file_path, text, module. A route line is looked at for nothing else.
    """
    some = files.filter(scanned(F.col("file_path")))
    rows = some.select("file_path", F.when(F.col("module") == "", "root").otherwise(F.col("module")).alias("module"), F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).withColumn("line_no", F.col("at") + 1)
    rows = commented(rows)
    t = F.col("t")
    path = F.regexp_extract(t, ROUTE + r'[^"]*"(/[^"]*)"', 1)
    entry = lambda direction, uri, port, proto, fmt: F.struct(F.lit(direction).alias("direction"), uri.alias("uri"), port.alias("port"), proto.alias("proto"), fmt.alias("data_fmt"))
    none = F.lit("")
    route = F.array(entry("in", path, none, F.lit("REST"), F.lit("JSON")))
    port = port_in(t)
    listener = F.when(t.contains("NWListener("), entry("in", F.when(port == "", "NWListener").otherwise(F.concat(F.lit(":"), port)), port, F.lit("TCP"), none))
    socket = F.lit(None)
    host = literal_in(t)
    low = F.lower(t)
    cases = None
    for needle, label, with_port in SOCKETS:
        uri = F.when(host == "", label).otherwise(F.when((port != "") & F.lit(with_port), F.concat(host, F.lit(":"), port)).otherwise(host)) if label != "NWPathMonitor" else F.lit(label)
        made = entry("out", uri, port if with_port else none, F.lit("TCP"), none)
        cases = F.when(t.contains(needle), made) if cases is None else cases.when(t.contains(needle), made)
        if label == "SCNetworkReachability":
            cases = cases.when(low.contains("sock_stream") & low.rlike("af_inet|pf_inet"), entry("out", F.lit("BSD socket"), none, F.lit("TCP"), none))
    socket = cases
    urls = F.filter(F.regexp_extract_all(t, F.lit(URL), F.lit(1)), lambda u: F.length(u) >= 10)
    by_url = F.transform(urls, lambda u: entry("out", u, F.regexp_extract(u, r"://[^/]*:([0-9]+)(?:/|$)", 1), F.when(u.rlike("^wss?:"), "WebSocket").otherwise(protocol(t)), F.when(u.rlike("^wss?:"), "").otherwise(data_format(t))))
    single = lambda x: F.when(x.isNotNull(), F.array(x)).otherwise(F.array().cast("array<struct<direction:string,uri:string,port:string,proto:string,data_fmt:string>>"))
    found = F.when(path != "", route).otherwise(F.concat(single(listener), by_url, single(socket)))
    out = rows.select("file_path", "module", "line_no", F.posexplode(found).alias("ord", "e")).select("e.*", "file_path", F.col("line_no").alias("line"), "module", "ord")
    first = top_per(out, ["direction", "uri", "proto", "module"], [F.col("file_path"), F.col("line"), F.col("ord")], 1)
    return first.drop("ord").orderBy("direction", F.when((F.col("proto") == "TCP") & (F.col("direction") == "out"), 0).otherwise(1), F.when(F.col("direction") == "out", F.col("proto")), "uri", "module")


def grouped(found: DataFrame, shown: int = 100) -> DataFrame:
    """direction, proto, uri, the number of call sites and the first ones in order."""
    keys = ["direction", "proto", "uri"]
    sites = found.select(*keys, "file_path", "line", "module")
    return examples_per(sites, keys, [F.col("file_path"), F.col("line"), F.col("module")], shown, "calls").withColumnRenamed("count", "sites")
