"""Architecture: layers, roles, pattern scores, framework components and assets, with the rules as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gneiss.functions.text import stem
from gneiss.functions.windows import top_per
from gneiss.operators.matching import overlapping

# fixed values: layer, parts of the path, ends of the name; the first that fits wins
LAYERS = (
    ("Tests", ("/test",), ("test", "tests", "spec", "mock", "stub", "fake")),
    ("API / Networking", ("/api/", "/network", "/service/", "/services/", "/endpoint"), ("api", "service", "client", "endpoint", "request", "response")),
    ("Models", ("/model/", "/models/", "/entity/", "/entities/", "/domain/"), ("model", "entity", "dto")),
    ("UI / Views", ("/viewmodel", "/presenter", "/interactor"), ("viewmodel", "presenter", "interactor", "coordinator")),
    ("UI / Views", ("/view/", "/views/", "/ui/", "/scene/", "/scenes/"), ("view", "screen", "cell", "controller", "viewcontroller")),
    ("Persistence", ("/storage", "/persistence", "/database", "/repository"), ("repository", "store", "storage", "cache", "dao")),
    ("Auth", ("/auth",), ("auth", "authenticator", "authorization")),
    ("Utilities", ("/util", "/helper", "/extension"), ("util", "helper", "extension", "extensions", "utils", "helpers")),
    ("Config", ("/config", "/setting"), ("config", "configuration", "settings", "constants", "constant")),
)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def layer(path: Column) -> Column:
    low = F.lower(path)
    name = F.lower(stem(path))
    out = None
    for label, parts, ends in LAYERS:
        fits = _any([low.contains(p) for p in parts] + [name.endswith(e) for e in ends])
        out = F.when(fits, label) if out is None else out.when(fits, label)
    return out.otherwise("Core")


def layer_totals(files: DataFrame) -> DataFrame:
    """files and lines of each layer; files has file_path and line_count."""
    return files.groupBy(layer(F.col("file_path")).alias("layer")).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))


@dataclass(frozen=True)
class Role:
    name: str
    ends: tuple[str, ...] = ()
    parts: tuple[str, ...] = ()
    decls: tuple[str, ...] = ()


# fixed values: roles by the end of the file name, parts of the path, and ends of declared names
ROLES = (
    Role("model", ("model", "dto"), ("/model/", "/models/"), ("model",)),
    Role("view"),
    Role("viewController", ("viewcontroller", "controller")),
    Role("viewModel", ("viewmodel",), ("/viewmodels/",), ("viewmodel",)),
    Role("presenter", ("presenter",), ("/presenters/",), ("presenter",)),
    Role("interactor", ("interactor",), ("/interactors/",), ("interactor",)),
    Role("router", ("router", "wireframe"), ("/routers/",), ("router", "wireframe")),
    Role("coordinator", ("coordinator",), ("/coordinators/",), ("coordinator",)),
    Role("entity", ("entity",), ("/entities/",), ("entity",)),
    Role("builder", ("builder",), ("/builders/",), ("builder",)),
    Role("feature", ("feature",), (), ("feature",)),
    Role("reducer", ("reducer",), ("/reducers/",), ("reducer",)),
    Role("service", ("service",), ("/services/",), ("service",)),
    Role("useCase", ("usecase",), ("/usecases/", "/use-cases/")),
    Role("repository", ("repository",), ("/repositories/", "/repository/")),
    Role("command", ("command",), ("/commands/", "/command/"), ("command",)),
    Role("eventBus", (), ("/eventbus/", "/event-bus/"), ("eventbus", "eventemitter", "eventcenter")),
    Role("facade", ("facade",), (), ("facade",)),
    Role("proxy", ("proxy",), ("/proxies/",), ("proxy",)),
    Role("mediator", ("mediator",), ("/mediators/",), ("mediator",)),
)


def role_stats(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """role, files, lines, decls, top_paths (the three longest) for every role.

    files: file_path, line_count, imports (array). declarations: file_path, name, kind.
    """
    spark = files.sparkSession
    p, n = F.lower("file_path"), F.lower(stem(F.col("file_path")))
    controllers = declarations.filter("kind = 'class' AND lower(name) LIKE '%viewcontroller'").select("file_path").distinct().withColumn("has_controller", F.lit(True))
    tests = []
    for r in ROLES:
        fits = _any([n.endswith(e) for e in r.ends] + [p.contains(x) for x in r.parts])
        if r.name == "view":
            named = _any([n.endswith(e) for e in ("view", "screen", "cell", "component")]) & ~n.endswith("viewcontroller") & ~n.endswith("viewmodel")
            placed = _any([p.contains(x) for x in ("/views/", "/view/")]) & ~p.contains("viewmodel") & ~p.contains("viewcontroller")
            fits = named | placed
        elif r.name == "viewController":
            fits = fits | F.col("has_controller").isNotNull()
        elif r.name == "eventBus":
            named = n.contains("eventbus") | n.contains("eventemitter") | (n.contains("notification") & ~n.endswith("controller"))
            fits = fits | named | F.arrays_overlap("imports", F.array(F.lit("EmitterKit"), F.lit("Signals")))
        tests.append(F.when(fits, F.lit(r.name)))
    marked = files.join(controllers, "file_path", "left")
    each = marked.select("file_path", "line_count", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("role"))
    per = each.groupBy("role").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"))
    top = top_per(each, ["role"], [F.col("line_count").desc(), F.col("file_path")], 3)
    top = top.groupBy("role").agg(F.array_sort(F.collect_list(F.struct((-F.col("line_count")).alias("n"), "file_path")))["file_path"].alias("top_paths"))
    low = F.lower("name")
    named = [F.when(_any([low.endswith(e) for e in r.decls] + ([low.contains("eventbus")] if r.name == "eventBus" else [])), F.lit(r.name)) for r in ROLES if r.decls]
    decls = declarations.filter("kind <> 'extension'").select(F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())).alias("role")).groupBy("role").agg(F.count("*").alias("decls"))
    roles = spark.createDataFrame([(r.name, i) for i, r in enumerate(ROLES)], "role string, ordinal int")
    return roles.join(per, "role", "left").join(decls, "role", "left").join(top, "role", "left").fillna(0, ["files", "lines", "decls"]).orderBy("ordinal").drop("ordinal")


def declaration_counts(declarations: DataFrame) -> DataFrame:
    """One row: protocols by the four logic suffixes, store, state and action types, notification extensions."""
    low, kind, name = F.lower("name"), F.col("kind"), F.col("name")
    proto = {"business": "BusinessLogic", "presentation": "PresentationLogic", "display": "DisplayLogic", "routing": "RoutingLogic"}
    own = kind != "extension"
    return declarations.agg(
        *(F.count_if((kind == "protocol") & name.endswith(s)).alias(a) for a, s in proto.items()),
        F.count_if(own & low.endswith("store")).alias("stores"),
        F.count_if(own & low.endswith("state") & ~low.endswith("uistate") & ~low.endswith("viewstate") & (low != "state")).alias("states"),
        F.count_if(own & low.endswith("action") & (low != "action")).alias("actions"),
        F.count_if((kind == "extension") & name.isin("Notification.Name", "NSNotification.Name")).alias("notification_names"),
    )


def features(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """One row with f_<role>, d_<role>, the declaration counts and the distinct imports."""
    stats = role_stats(files, declarations)
    wide = stats.agg(*(F.coalesce(F.max(F.when(F.col("role") == r.name, F.col(c))), F.lit(0)).alias(f"{c[0]}_{r.name}") for r in ROLES for c in ("files", "decls")))
    imports = files.select(F.explode("imports").alias("i")).agg(F.collect_set("i").alias("imports"))
    return wide.join(declaration_counts(declarations)).join(imports)  # one row each


# fixed values: points of each pattern by what it is counted on; of a group's tiers (at least, points) the highest one reached counts.
# f: files of a role, d: its types, t: both; i: whether a module is imported
TIERS = (
    ("TCA", "base", "i_ComposableArchitecture", ((1, 0.65),)),
    ("TCA", "base", "f_feature", ((2, 0.20), (1, 0.10))),
    ("TCA", "base", "d_feature", ((2, 0.10), (1, 0.05))),
    ("TCA", "base", "f_reducer", ((2, 0.05), (1, 0.02))),
    ("TCA", "base", "d_reducer", ((2, 0.10), (1, 0.05))),
    ("TCA", "base", "states", ((2, 0.08), (1, 0.04))),
    ("TCA", "base", "actions", ((2, 0.08), (1, 0.04))),
    ("TCA", "base", "stores", ((1, 0.05),)),
    ("VIP", "base", "business", ((1, 0.30),)),
    ("VIP", "base", "presentation", ((1, 0.25),)),
    ("VIP", "base", "display", ((1, 0.20),)),
    ("VIP", "base", "routing", ((1, 0.15),)),
    ("VIP", "base", "f_interactor", ((2, 0.05), (1, 0.02))),
    ("VIP", "base", "f_presenter", ((2, 0.05), (1, 0.02))),
    ("VIPER", "hits", "views", ((1, 1.0),)),
    ("VIPER", "hits", "t_interactor", ((1, 1.0),)),
    ("VIPER", "hits", "t_presenter", ((1, 1.0),)),
    ("VIPER", "hits", "t_entity", ((1, 1.0),)),
    ("VIPER", "hits", "t_router", ((1, 1.0),)),
    ("RIBs", "base", "t_builder", ((3, 0.35), (2, 0.25), (1, 0.15))),
    ("RIBs", "base", "t_router", ((3, 0.30), (2, 0.22), (1, 0.12))),
    ("RIBs", "base", "t_interactor", ((3, 0.25), (2, 0.18), (1, 0.10))),
    ("Clean", "hits", "f_useCase", ((1, 1.0),)),
    ("Clean", "hits", "f_repository", ((1, 1.0),)),
    ("Clean", "hits", "t_entity", ((2, 1.0),)),
    ("Clean", "base", "f_useCase", ((3, 0.35), (2, 0.25), (1, 0.15))),
    ("Clean", "base", "f_repository", ((2, 0.30), (1, 0.18))),
    ("Clean", "base", "t_entity", ((2, 0.15),)),
    ("Clean", "base", "f_service", ((1, 0.08),)),
    ("Redux", "base", "i_ReSwift|Redux", ((1, 0.55),)),
    ("Redux", "base", "states", ((2, 0.20), (1, 0.10))),
    ("Redux", "base", "actions", ((2, 0.20), (1, 0.10))),
    ("Redux", "base", "t_reducer", ((1, 0.08),)),
    ("Redux", "base", "f_reducer", ((2, 0.07),)),
    ("Redux", "base", "stores", ((1, 0.10),)),
    ("MVVM+C", "base", "t_viewModel", ((2, 0.50), (1, 0.35))),
    ("MVVM+C", "base", "f_viewModel", ((3, 0.20),)),
    ("MVVM+C", "base", "f_coordinator", ((2, 0.15),)),
    ("MVVM+C", "base", "f_model", ((1, 0.10),)),
    ("MVVM+S", "base", "t_viewModel", ((2, 0.45), (1, 0.30))),
    ("MVVM+S", "base", "f_viewModel", ((3, 0.15),)),
    ("MVVM+S", "base", "t_service", ((4, 0.30), (2, 0.20))),
    ("MVVM+S", "base", "f_model", ((1, 0.10),)),
    ("MVVM", "base", "t_viewModel", ((2, 0.40), (1, 0.22))),
    ("MVVM", "base", "f_viewModel", ((3, 0.20),)),
    ("MVVM", "base", "f_model", ((2, 0.15),)),
    ("MVVM", "base", "views", ((2, 0.15),)),
    ("MVVM", "penalty", "t_coordinator", ((1, 0.20),)),
    ("MVVM", "penalty", "t_service", ((2, 0.15),)),
    ("MVP", "base", "t_presenter", ((2, 0.50), (1, 0.30))),
    ("MVP", "base", "f_presenter", ((3, 0.20),)),
    ("MVP", "base", "views", ((2, 0.20),)),
    ("MVP", "base", "f_model", ((1, 0.10),)),
    ("MVC", "base", "f_viewController", ((5, 0.60), (2, 0.40), (1, 0.25))),
    ("MVC", "base", "i_UIKit", ((1, 0.20),)),
    ("MVC", "base", "f_model", ((1, 0.10),)),
    ("MV", "base", "i_SwiftUI", ((1, 0.50),)),
    ("MV", "base", "f_view", ((3, 0.30),)),
    ("MV", "base", "f_model", ((1, 0.20),)),
    ("PureMVC", "hits", "t_facade", ((1, 1.0),)),
    ("PureMVC", "hits", "t_proxy", ((1, 1.0),)),
    ("PureMVC", "hits", "t_mediator", ((1, 1.0),)),
    ("PureMVC", "hits", "t_command", ((1, 1.0),)),
    ("PureMVC", "base", "i_PureMVC", ((1, 0.75),)),
    ("PureMVC", "base", "t_facade", ((1, 0.10),)),
    ("PureMVC", "base", "t_proxy", ((3, 0.15), (1, 0.08))),
    ("PureMVC", "base", "t_mediator", ((3, 0.15), (1, 0.08))),
    ("PureMVC", "base", "t_command", ((3, 0.10), (1, 0.05))),
)
PATTERNS = tuple(dict.fromkeys(t[0] for t in TIERS))
FEATURES = tuple(
    [f"{x}_{r.name}" for r in ROLES for x in "fdt"]
    + ["views", "business", "presentation", "display", "routing", "stores", "states", "actions"]
    + ["i_ComposableArchitecture", "i_ReSwift|Redux", "i_UIKit", "i_SwiftUI", "i_PureMVC"]
)


def feature_values(row: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, feature, value) from rows of ``features``: what the tiers of the patterns are held against."""
    f, d = (lambda r: F.col(f"f_{r}")), (lambda r: F.col(f"d_{r}"))
    value = {f"f_{r.name}": f(r.name) for r in ROLES} | {f"d_{r.name}": d(r.name) for r in ROLES} | {f"t_{r.name}": f(r.name) + d(r.name) for r in ROLES}
    value |= {"views": f("view") + f("viewController")} | {c: F.col(c) for c in ("business", "presentation", "display", "routing", "stores", "states", "actions")}
    value |= {x: F.arrays_overlap("imports", F.array(*map(F.lit, x[2:].split("|")))).cast("long") for x in FEATURES if x.startswith("i_")}
    pairs = F.array(*(F.struct(F.lit(x).alias("feature"), F.coalesce(value[x], F.lit(0)).cast("long").alias("value")) for x in FEATURES))
    return row.select(*(keys or []), F.explode(pairs).alias("v")).select(*(keys or []), "v.*")


def scorecard(values: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pattern, score) of every pattern for every key, from (keys, feature, value); a feature without a row is 0.

    Values meet the table of tiers by their feature, what they reach is summed per pattern, and each pattern's
    conditions are applied to the sums; any number of projects are scored at once.
    """
    rows = [(p, part, x, least, points) for p, part, x, tiers in TIERS for least, points in tiers]
    tiers = values.sparkSession.createDataFrame(rows, "pattern string, part string, feature string, least long, points double")
    reached = values.join(F.broadcast(tiers), "feature").filter("value >= least").groupBy(*keys, "pattern", "part", "feature").agg(F.max("points").alias("points"))
    part = lambda x: F.sum(F.when(F.col("part") == x, F.col("points"))).alias(x)
    sums = reached.groupBy(*keys, "pattern").agg(part("base"), part("hits"), part("penalty"))
    wide = values.groupBy(*keys).agg(*(F.coalesce(F.max(F.when(F.col("feature") == x, F.col("value"))), F.lit(0)).alias(x) for x in FEATURES))
    # the sums of a key's patterns are one array, so that the wide rows meet them once and are not multiplied before
    of_key = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pattern", F.struct("base", "hits", "penalty")))).alias("sums"))
    both = wide.join(of_key.hint("merge"), keys, "left") if keys else wide.join(of_key)
    got = both.withColumn("pattern", F.explode(F.array(*map(F.lit, PATTERNS)))).withColumn("sum", F.try_element_at("sums", F.col("pattern")))
    got = got.withColumns({x: F.coalesce(F.col(f"sum.{x}"), F.lit(0.0)) for x in ("base", "hits", "penalty")})
    f, t = (lambda r: F.col(f"f_{r}")), (lambda r: F.col(f"t_{r}"))
    imported = lambda m: F.col(f"`i_{m}`") > 0
    views, base, hits = F.col("views"), F.col("base"), F.col("hits")
    few = lambda c, share: (views >= 20) & (c < F.greatest(F.lit(1), F.floor(views / share)))
    logic = F.col("business") + F.col("presentation") + F.col("display")
    # fixed values: when a pattern scores nothing
    none = {
        "VIPER": hits < 2,
        "Clean": hits < 2,
        "Redux": imported("ComposableArchitecture"),
        "MVVM+C": (t("viewModel") < 1) | (t("coordinator") < 1) | few(f("coordinator"), 200) | ((t("service") > t("coordinator")) & (t("coordinator") <= 1)),
        "MVVM+S": (t("viewModel") < 1) | (f("service") < 1) | few(f("service"), 100) | (t("service") < t("coordinator")),
        "MVVM": (t("viewModel") < 1) | few(f("viewModel"), 100),
        "MVP": (t("presenter") < 1) | (t("viewModel") > 0),
        "MVC": (f("viewController") < 1) | (t("viewModel") > 0) | (f("presenter") > 0) | imported("ComposableArchitecture"),
        "MV": ~imported("SwiftUI") | (t("viewModel") > 0) | (f("viewController") > 0),
        "PureMVC": ~imported("PureMVC") & (hits < 2),
    }
    # and what is more than a sum
    made = {
        "VIPER": hits / 5 * 0.85 - F.least(logic * 0.05, F.lit(0.3)),
        "RIBs": base + F.when(base > 0, 0.10).otherwise(0.0),
        "MVVM": base - F.least(F.col("penalty"), F.lit(0.25)),
        "MVC": base + F.when(f("router") == 0, 0.10).otherwise(0.0),
    }
    score = F.lit(0.0)
    for p in PATTERNS:
        score = F.when(F.col("pattern") == p, F.when(none[p], 0.0).otherwise(made.get(p, base)) if p in none else made.get(p, base)).otherwise(score)
    return got.select(*keys, "pattern", F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))).alias("score"))


def patterns(files: DataFrame, declarations: DataFrame, threshold: float = 0.15, k: int = 5) -> DataFrame:
    """The k best patterns (pattern, score) of at least the threshold."""
    scores = scorecard(feature_values(features(files, declarations)), [])
    place = F.array_position(F.array(*map(F.lit, PATTERNS)), F.col("pattern"))
    return scores.filter(F.col("score") >= threshold).orderBy(F.round("score", 9).desc(), place).limit(k)


def role_health(files: Column, lines: Column, decls: Column) -> Column:
    """missing, weak (one small file, one type at most) or present."""
    return F.when((files == 0) & (decls == 0), "missing").when((files <= 1) & (lines < 150) & (decls <= 1), "weak").otherwise("present")


# fixed values: the roles that a pattern's letters stand for
LETTERS = (
    ("TCA", ("feature", "state", "action", "reducer")),
    ("VIP", ("view", "interactor", "presenter")),
    ("VIPER", ("view", "interactor", "presenter", "entity", "router")),
    ("RIBs", ("router", "interactor", "builder")),
    ("Clean", ("useCase", "repository", "entity")),
    ("Redux", ("state", "action", "reducer", "store")),
    ("MVVM+C", ("model", "view", "viewModel", "coordinator")),
    ("MVVM+S", ("model", "view", "viewModel", "service")),
    ("MVVM", ("model", "view", "viewModel")),
    ("MVP", ("model", "view", "presenter")),
    ("MVC", ("model", "view", "viewController")),
    ("MV", ("model", "view")),
    ("PureMVC", ("facade", "proxy", "mediator", "command")),
)


def all_roles(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """role, files, lines, decls: the roles, and state, action and store types, which have no files of their own."""
    roles = role_stats(files, declarations).select("role", "files", "lines", "decls")
    kinds = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("lines"), F.col(c).alias("decls")) for r, c in (("state", "states"), ("action", "actions"), ("store", "stores"))))
    return roles.unionByName(declaration_counts(declarations).select(F.explode(kinds).alias("k")).select("k.*"))


def letter_health(found: DataFrame, roles: DataFrame) -> DataFrame:
    """pattern, ordinal, role, files, decls and health of every letter of patterns (pattern), from ``all_roles``."""
    table = found.sparkSession.createDataFrame([(p, i, r) for p, some in LETTERS for i, r in enumerate(some)], "pattern string, ordinal int, role string")
    return found.join(F.broadcast(table), "pattern").join(roles, "role").select(*found.columns, "ordinal", "role", "files", "decls", role_health(F.col("files"), F.col("lines"), F.col("decls")).alias("health"))


def pattern_letters(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """pattern, role, files, decls and health of every letter of the patterns found."""
    found = letter_health(patterns(files, declarations), all_roles(files, declarations))
    return found.orderBy(F.round("score", 9).desc(), "pattern", "ordinal").select("pattern", "ordinal", "role", "files", "decls", "health")


def letters(files: DataFrame, declarations: DataFrame) -> DataFrame:
    """One row: whether a command layer and an event bus stand beside the pattern; a weak one is hidden by a strong pattern."""
    row = features(files, declarations).join(role_stats(files, declarations).filter("role = 'command'").select(F.col("lines").alias("command_lines")))
    best = scorecard(feature_values(features(files, declarations)), []).agg(F.max("score").alias("top"))
    row, top = row.join(best), F.col("top")  # one row each
    health = role_health(F.col("f_command"), F.col("command_lines"), F.col("d_command"))
    bus = (F.col("f_eventBus") > 0) | F.arrays_overlap("imports", F.array(F.lit("EmitterKit"), F.lit("Signals"))) | (F.col("notification_names") >= 3)
    return row.select(((health == "present") | ((health == "weak") & (top < 0.5))).alias("command"), bus.alias("event_bus"))


# fixed values: components by the frameworks that show them
COMPONENTS = (
    ("SwiftUI", "Declarative UI", ("SwiftUI",)), ("UIKit", "Imperative UI", ("UIKit",)), ("AppKit", "macOS UI", ("AppKit",)), ("Combine", "Reactive Streams", ("Combine",)),
    ("CoreData", "Object Graph Persistence", ("CoreData",)), ("SwiftData", "Swift-native Persistence", ("SwiftData",)), ("AR / Reality", "Augmented Reality", ("ARKit", "RealityKit")),
    ("CoreML", "Machine Learning", ("CoreML", "CreateML")), ("MapKit", "Maps & Location", ("MapKit",)), ("AVFoundation", "Audio / Video", ("AVFoundation", "AVKit")),
    ("Bluetooth", "BLE Communication", ("CoreBluetooth",)), ("HealthKit", "Health Data", ("HealthKit",)), ("Auth Services", "Authentication", ("AuthenticationServices", "LocalAuthentication")),
    ("StoreKit", "In-App Purchases", ("StoreKit",)), ("CloudKit", "iCloud Sync", ("CloudKit",)), ("CryptoKit", "Cryptography", ("CryptoKit",)), ("Vision", "Computer Vision", ("Vision",)),
    ("NaturalLanguage", "Text Analysis", ("NaturalLanguage",)), ("Metal", "GPU Computing", ("Metal", "MetalKit")), ("Game", "Game Services", ("GameKit", "SpriteKit", "GameplayKit")),
    ("Location", "Location Services", ("CoreLocation", "CoreLocationUI")), ("Notifications", "Push & Local", ("UserNotifications", "PushKit")), ("WebKit", "Web Rendering", ("WebKit",)),
    ("Network", "Low-level Networking", ("Network", "NetworkExtension")), ("Motion / Sensors", "Device Sensors", ("CoreMotion", "SensorKit")), ("Photos", "Photo Library", ("Photos", "PhotosUI")),
    ("Contacts", "Address Book", ("Contacts", "ContactsUI")), ("EventKit", "Calendar & Reminders", ("EventKit",)), ("Haptics", "Haptic Feedback", ("CoreHaptics",)), ("SceneKit", "3D Scenes", ("SceneKit",)),
    ("App Intents", "Siri & Shortcuts", ("AppIntents",)), ("WidgetKit", "Home Screen Widgets", ("WidgetKit",)), ("Testing", "Unit & UI Tests", ("SwiftTesting", "XCTest")), ("Observation", "Swift Observation", ("Observation",)),
)


def components(spark: SparkSession, imports: DataFrame) -> DataFrame:
    """Components (ordinal, name, detail, matched) whose frameworks are imported; imports has name."""
    rules = spark.createDataFrame([(i, n, d, list(f)) for i, (n, d, f) in enumerate(COMPONENTS)], "ordinal int, name string, detail string, frameworks array<string>")
    return overlapping(rules, "frameworks", imports, "name")


def asset_totals(assets: DataFrame, k: int = 3) -> DataFrame:
    """ext, files, bytes and the k largest of each type; assets: rel_path, ext, size_bytes (ord breaks ties)."""
    ordered = assets if "ord" in assets.columns else assets.withColumn("ord", F.col("rel_path"))
    per = ordered.groupBy("ext").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))
    top = top_per(ordered, ["ext"], [F.col("size_bytes").desc(), F.col("ord")], k)
    top = top.groupBy("ext").agg(F.array_join(F.array_sort(F.collect_list(F.struct((-F.col("size_bytes")).alias("n"), "ord", "rel_path")))["rel_path"], ",").alias("largest"))
    return per.join(top, "ext")
