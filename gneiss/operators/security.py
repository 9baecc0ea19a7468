"""The security checks: one generic matcher over lines, with the checks as data.

A line has its raw text, ``code`` (string literals blanked) and ``bare`` (trailing comment cut). All line
checks are tested in one projection and exploded; file and project checks are grouped booleans. Hits are
capped per file and summed, categories are scored by weighted density.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss.functions.lineage import cut
from gneiss.functions.text import basename, calls, display_path, is_comment, snippet, trim
from gneiss.functions.windows import around, frame, previous
from gneiss.operators import matching

CAP = 100
# fixed values: category weights (sum 1000) and what a hit counts by priority
WEIGHTS = {
    "insecureDataStorage": 130, "crashFactors": 120, "cryptography": 110, "authentication": 100, "networkSecurity": 90,
    "memoryCorruption": 80, "ioValidation": 80, "unsafeDeprecated": 60, "supplyChain": 50, "privacy": 50,
    "binaryProtections": 40, "iosConfiguration": 40, "logicState": 30, "lowLevelBinary": 20,
}
MULTIPLIERS = {"high": 2.0, "medium": 1.0, "low": 0.5}

# fixed values: vocabularies of the checks
SKIP_WORDS = ["example", "test", "dummy", "fake", "sample", "placeholder", "your_", "xxx", "todo", "changeme", "insert", "enter", "undefined"]
PLACEHOLDERS = ["example", "test", "dummy", "fake", "sample", "placeholder", "your_", "xxx", "todo", "changeme", "insert", "enter", "redacted", "null", "none"]
CRYPTO_PATHS = ["SecureId", "Encrypt", "Decrypt", "Crypto", "Signing", "SecretChat", "Authentication", "SecretKey", "CryptoUtils"]
UI_NAMES = ["View", "Node", "Animation", "Component", "Button", "Panel"]
ANIMATION_WORDS = ["degrees", "velocity", "lifetime", "startAngle", "randAngle", ".seed =", "beginTime"]
TOOLING_PATHS = ["/tools/", "/scripts/", "/xcodegenkit", "/xcodegen", "/pbxproj/", "swiftc_stub", "/sourceryworker", "/tuist/", "/fastlane/", "/ci/", "/bin/"]
VENDOR_PATHS = ["/openh264", "/webrtc", "/examples/", "/example/", "/demo/", "/demos/", "/vendor/", "/pods/", "/node_modules/", "/.build/"]
JWT = r"eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]{4,}"
KEYWORD = r'(?i)\b(password|passwd|secret|apiKey|api_key|authKey|token|privateKey|private_key|clientSecret|appSecret)\b\s*[=:]\s*"([^"]{8,})"'
KEY_ASSIGNMENT = r"""(?i)\b(password|passwd|secret|api[_-]?key|auth[_-]?key|access[_-]?token|private[_-]?key|client[_-]?secret|app[_-]?secret|encryption[_-]?key|symmetric[_-]?key)\b\s*[=:]\s*["']([^"']{8,})["']"""
PREFERENCE = r'UserDefaults\.standard\.set\([^,]+,\s*forKey:\s*"[^"]*(?i)(password|token|secret|key|auth|credential)[^"]*"'
SERVICE_KEYS = r"""["'](AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|ghp_[A-Za-z0-9]{36}|gho_[A-Za-z0-9]{36}|ghs_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{59}|sk_live_[0-9a-zA-Z]{24,}|sk_test_[0-9a-zA-Z]{24,}|xoxb-[0-9]{11}-[0-9A-Za-z\-]{24,}|xoxp-[0-9]+-[0-9]+-[0-9A-Za-z\-]+|AIza[0-9A-Za-z\-_]{35}|sk-ant-[A-Za-z0-9_\-]{20,})["']"""
PLAIN_URL = r'"http://[A-Za-z0-9]([A-Za-z0-9\-\.]*[A-Za-z0-9])?(:[0-9]+)?(/[^"]*)?"'
NESTED_REPEAT = r"\([^()\n]{1,60}[+*][^()\n]{0,20}\)[+*]|\([^()\n]{0,30}\|[^()\n]{0,30}[+*][^()\n]{0,10}\)[+*]"
HTML_TAG = r'"[^"]*<[a-zA-Z][a-zA-Z0-9]*[\s>/][^"]*\\\('
ENV_NAMES = [".env", ".env.local", ".env.production", ".env.staging", ".env.development"]
ENV_KEY = r"(?i)^[ \t]*(PASSWORD|PASSWD|SECRET|API_KEY|APIKEY|TOKEN|PRIVATE_KEY|DB_PASS(?:WORD)?|ACCESS_KEY|AUTH_TOKEN|CLIENT_SECRET|APP_SECRET|ENCRYPTION_KEY|HMAC_KEY|JWT_SECRET|SIGNING_KEY|MASTER_KEY|PSK)\s*=\s*(.+)"
ENV_SKIP = ["${", "$(", "%{", "changeme", "your_", "xxx", "placeholder", "example", "test", "dummy", "todo", "insert", "redacted", "null", "none"]
PERMISSIONS = {
    "NSMicrophoneUsageDescription": ("Microphone", ["AVAudioSession", "AVAudioRecorder", "AVCaptureDevice"]),
    "NSCameraUsageDescription": ("Camera", ["AVCaptureDevice", "AVCaptureSession", "UIImagePickerController", "PHPickerViewController"]),
    "NSLocationWhenInUseUsageDescription": ("Location", ["CLLocationManager", "startUpdatingLocation", "requestWhenInUseAuthorization"]),
    "NSLocationAlwaysUsageDescription": ("Location Always", ["CLLocationManager", "requestAlwaysAuthorization", "startMonitoringSignificantLocationChanges"]),
    "NSContactsUsageDescription": ("Contacts", ["CNContactStore", "CNContact"]),
    "NSPhotoLibraryUsageDescription": ("Photo Library", ["PHPhotoLibrary", "PHAsset", "PHImageManager"]),
    "NSBluetoothAlwaysUsageDescription": ("Bluetooth", ["CBCentralManager", "CBPeripheralManager"]),
    "NSFaceIDUsageDescription": ("Face ID", ["LAContext", "evaluatePolicy"]),
    "NSCalendarsUsageDescription": ("Calendars", ["EKEventStore", "EKCalendar"]),
    "NSRemindersUsageDescription": ("Reminders", ["EKReminder", "EKEventStore"]),
}
JAILBREAK = ["cydia://", "Cydia.app", "sileo://", "isJailbroken", "JailbreakDetect", "IOSSecuritySuite", "JailMonkey", "/private/var/lib/apt", "/Applications/Cydia.app"]
ANTI_TAMPER = ["PT_DENY_ATTACH", "isDebuggerAttached", "AmIBeingDebugged", "proc_pid_debug", "kern.proc.pid", "TARGET_OS_SIMULATOR", "TARGET_IPHONE_SIMULATOR", "SIMULATOR_DEVICE_NAME", "DYLD_INSERT_LIBRARIES", "MSHookMessage", "MSHookFunction", "/Library/MobileSubstrate/", "SubstrateLoader", "fishhook"]
CONFIG_KEYS = ["apikey", "api_key", "secret", "password", "passwd", "token", "auth_key", "private_key", "client_secret", "access_key"]
CONFIG_SKIP = ["example", "test", "dummy", "fake", "sample", "placeholder", "your_", "xxx", "todo", "changeme", "$(", "${"]


def any_of(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | c.contains(n)
    return out


def any_call(c: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | calls(c, n)
    return out


@dataclass(frozen=True)
class Line:
    """The columns a line check may use."""

    raw: Column
    code: Column
    bare: Column
    low: Column
    path: Column


@dataclass(frozen=True)
class Check:
    id: int
    name: str
    priority: str
    category: str
    kind: str  # line, file (first hit of a file), project
    skips_tests: bool = False
    hit: Callable[[Line], Column] | None = None
    veto: Callable[[Line], Column] | None = None  # file: no hit if any line has it
    in_comments: bool = False


def _secret_value(line: Line, pattern: str, words: list[str], json_key: str) -> Column:
    value = F.lower(F.regexp_extract(line.raw, pattern, 2))
    return line.raw.rlike(pattern) & ~(value.rlike(json_key) & (F.length(value) <= 40)) & ~any_of(value, words)


def _hardcoded_secret(line: Line) -> Column:
    case = trim(line.raw).startswith("case ")
    keyword = _secret_value(line, KEYWORD, SKIP_WORDS, "^[a-z][a-z0-9_]*$")
    hexa = line.raw.rlike(r'=\s*"([0-9a-fA-F]{32,})"') & ~any_of(line.low, SKIP_WORDS)
    return ~case & (keyword | hexa | line.raw.rlike(f'"({JWT})"'))


def _encryption_key(line: Line) -> Column:
    case = trim(line.raw).startswith("case ")
    keyword = _secret_value(line, KEY_ASSIGNMENT, PLACEHOLDERS, "^[a-z][a-z0-9]*(_[a-z0-9]+)+$")
    hexa = line.raw.rlike(r"""[:=]\s*["']([0-9a-fA-F]{32,})["']""") & ~any_of(line.low, PLACEHOLDERS)
    made = any_of(line.code, ["SymmetricKey(data:", "SecKeyCreateWithData"]) & line.raw.rlike('"[^"]{8,}"')
    bytes_ = line.code.contains("[UInt8]") & line.code.contains("= [") & line.code.rlike(r"\b(encryptionKey|symmetricKey|privateKey|secretKey|cipherKey|aesKey)\b")
    return ~case & (keyword | hexa | line.raw.rlike(f"""["']({JWT})["']""") | made | bytes_)


def _force_unwrap(line: Line) -> Column:
    code = line.code
    for a, b in (("try!", "try_"), (" as!", " as_"), ("(as!", "(as_"), ("\tas!", "\tas_")):
        code = F.replace(code, F.lit(a), F.lit(b))
    return ~F.col("in_text") & ~any_of(line.raw, ["@IBOutlet", "@IBAction"]) & code.rlike(r"[a-zA-Z0-9_\])]!(?!=)(?![a-zA-Z_(])")


def _sql(line: Line) -> Column:
    words = any_of(F.upper(line.raw), ["SELECT ", "INSERT INTO", "UPDATE ", "DELETE FROM", "DROP TABLE", "CREATE TABLE", "ALTER TABLE"])
    filled = F.regexp_extract_all(line.raw, F.lit(r"\\\([A-Za-z_][A-Za-z0-9_]*(?:\.[A-Za-z0-9_]+)*\)"), F.lit(0))
    safe = F.forall(filled, lambda e: F.lower(e).rlike(r"\.(id|rawvalue|count|row|section|index|tag|offset|version|type)\)$"))
    return line.raw.contains("\\(") & words & ~(line.raw.contains("?") & (F.size(filled) > 0) & safe)


def _plain_url(line: Line) -> Column:
    low = F.lower(line.bare)
    local = any_of(low, ["localhost", "127.0.0.1", "10.0.", "<html", "</html", "wkwebview", "loadhtmlstring"])
    return line.bare.contains('"http://') & ~line.bare.contains('"http://"') & ~local & line.bare.rlike(PLAIN_URL)


def _clipboard(line: Line) -> Column:
    read = any_of(line.code, ["UIPasteboard.general", "NSPasteboard.general"]) & any_of(line.code, [".string", ".strings", ".data("])
    written = any_of(line.code, [".setValue(", ".setObjects(", ".setItems(", ".string =", ".strings ="])
    by_user = any_of(F.col("before5"), ["copy(", "paste(", "cut(", "copytapped", "copybuttontapped", "oncopytap", "copyaction", "handlecopy", "copylink", "copytext"])
    return read & ~written & ~by_user


def _path_traversal(line: Line) -> Column:
    dots = any_of(line.raw, ['"../', '"..\\']) | (line.raw.contains("appendingPathComponent(") & line.raw.contains('".."'))
    filled = any_of(line.raw, ["appendingPathComponent(", "appendingPathExtension("]) & line.raw.contains("\\(")
    real = any_of(line.code, ["stringByResolvingSymlinksInPath", "standardized"]) & any_of(line.code, ["contentsOfFile", "createFile", "removeItem", "copyItem"])
    return ~line.path.endswith("/Package.swift") & ~any_of(F.lower(line.path), TOOLING_PATHS) & (dots | filled | real)


def _shell(line: Line) -> Column:
    entry = any_of(line.code, ["/bin/sh", "/bin/bash", "/usr/bin/env", "Process()", "NSTask()", "popen("])
    filled = any_of(line.code, [".arguments", "launchPath"]) & line.raw.contains("\\(")
    joined = line.code.contains(".arguments") & any_of(line.raw, ["| ", "; ", "&&", "`"])
    return ~any_of(F.lower(line.path), TOOLING_PATHS) & (entry | filled | joined)


def _disk_cache(line: Line) -> Column:
    removed = any_of(line.code, ["removeData(", "removeAllCachedResponses(", "removeAll(", "fetchDataRecords(", ".nonPersistent("])
    disk = line.code.contains("URLCache(") & line.raw.contains("diskCapacity:") & ~F.lower(F.regexp_replace(line.raw, r"\s+", " ")).contains("diskcapacity: 0")
    shared = line.code.contains("urlCache") & any_of(line.code, ["= URLCache.shared", "= .shared"])
    return ~removed & (disk | line.code.contains("WKWebsiteDataStore.default()") | shared)


def _file_race(line: Line) -> Column:
    plain = line.code.contains(".write(to:") & ~any_of(line.code, [".atomic", "options:"])
    made = line.code.contains("createFile(atPath:") & ~F.lower(F.col("around")).contains("protection") & ~F.col("around").contains("NSFileProtect")
    return plain | made | any_of(line.code, ["FileHandle(forWritingAtPath:", "FileHandle(forUpdatingAtPath:"])


def _objc(line: Line) -> Column:
    ext = F.lower(line.path).rlike(r"\.mm?$")
    sent = any_call(line.code, ["objc_msgSend(", "objc_msgSendSuper(", "objc_msgSend_stret("])
    named = line.code.contains("performSelector:") & line.code.contains("NSSelectorFromString(")
    invoked = line.code.contains("NSInvocation") & any_of(line.code, ["invocationWithMethodSignature", "setSelector:", "invoke]"])
    return ext & (sent | named | invoked)


def _web_script(line: Line) -> Column:
    flags = ["allowFileAccessFromFileURLs", "allowUniversalAccessFromFileURLs", "javaScriptEnabled = true", "allowContentJavaScript = true", "isFraudulentWebsiteWarningEnabled = false"]
    return (line.raw.contains("evaluateJavaScript(") & line.raw.contains("\\(")) | any_of(line.code, flags)


def _hardcoded_iv(line: Line) -> Column:
    literal = line.code.rlike(r'(?i)\b(iv|nonce|initialVector|initializationVector)\s*[=:]\s*[\["]')
    return literal | line.raw.rlike(r"(?i)\b(iv|nonce|initialVector)\s*[=:]\s*(Data\(bytes?\s*:|UInt8\]|Data\(\[)")


def _html(line: Line) -> Column:
    escaped = ["htmlEscape(", "esc(", "xmlEscape", "addingPercentEncoding", 'replacingOccurrences(of: "<"', "sanitizeHTML", ".htmlEncoded", "CharacterSet.html", "HTMLEntities"]
    return line.raw.contains("\\(") & ~any_of(line.raw, escaped) & line.raw.rlike(HTML_TAG)


def _public_log(line: Line) -> Column:
    logs = any_of(line.low, ["os_log(", "logger.", "logger("])
    return logs & line.raw.contains("%@") & ~any_of(line.raw, ["{private}", "{sensitive}"]) & any_of(line.low, ["password", "passwd", "token", "secret", "key", "credential", "auth", "pin"])


def _secret_log(line: Line) -> Column:
    called = line.raw.rlike(r"(?<![A-Za-z0-9_])(print|debugPrint|NSLog|os_log|Logger\.\w+)\s*\(")
    return called & any_of(line.low, ["password", "passwd", "token", "secret", "apikey", "api_key", "credential", "private_key", "privatekey"])


def _weak_hash(line: Line) -> Column:
    path = F.lower(line.path)
    forms = ["CC_MD5(", "CC_MD5_Init", "CC_SHA1(", "CC_SHA1_Init", "Insecure.MD5", "Insecure.SHA1", "HashAlgorithm.md5", ".md5.rawValue"]
    return ~any_of(path, [*TOOLING_PATHS, "pbxproj", "identifier"]) & any_of(line.code, forms)


def code_has(*needles: str) -> Callable[[Line], Column]:
    return lambda line: any_of(line.code, list(needles))


def code_calls(*needles: str) -> Callable[[Line], Column]:
    return lambda line: any_call(line.code, list(needles))


RANDOM = ["arc4random()", "arc4random_uniform("]
WEAK_ALGORITHMS = ["kCCAlgorithmDES", "kCCAlgorithm3DES", "kCCAlgorithmRC2", "kCCAlgorithmRC4", "kCCAlgorithmCAST"]
WEAK_NAMES = ["SHA1withRSA", "SHA1withECDSA", "SHA-1", "MD2withRSA", "SSL_DES", "SSL_3DES", "kSSLCipherSuite3DES", "kSSLCipherSuiteDES", "CCAlgorithm.des", "CCAlgorithm.tripleDes", "CCAlgorithm.rc4", ".des ", ".tripleDes ", ".rc4 ", "TLS_RSA_WITH_3DES", "TLS_RSA_WITH_DES", "TLS_RSA_WITH_RC4"]
CRASH_REPORTERS = ["PLCrashReporter(", "Crashlytics.crashlytics()", "FirebaseCrashlytics.crashlytics()", "SentrySDK.start(", "Bugsnag.start(", "BugsnagConfiguration("]
SCRUBBING = ["beforeSend", "onBeforeSend", "eventProcessor", "beforeBreadcrumb", "redactedKeys", "setUserIdentifier", "anonymize", "sanitize"]

CHECKS = (
    Check(1, "Hardcoded Secrets", "high", "insecureDataStorage", "line", True, _hardcoded_secret),
    Check(2, "UserDefaults Only for Non-Sensitive Data", "high", "insecureDataStorage", "line", False, lambda n: n.raw.rlike(PREFERENCE)),
    Check(3, "Insecure Randomness in Security Context (arc4random)", "high", "cryptography", "line", False, lambda n: any_of(n.path, CRYPTO_PATHS) & any_of(n.code, RANDOM)),
    Check(4, "Deprecated arc4random in Non-Security Code", "low", "unsafeDeprecated", "line", False, lambda n: ~any_of(n.path, CRYPTO_PATHS) & ~any_of(basename(n.path), UI_NAMES) & any_of(n.code, RANDOM) & ~any_of(n.raw, ANIMATION_WORDS)),
    Check(5, "Never Force Try (try!)", "high", "crashFactors", "line", True, lambda n: n.code.rlike(r"\btry!\s")),
    Check(6, "Never Force Unwrap (!)", "high", "crashFactors", "line", True, _force_unwrap),
    Check(7, "Avoid Force Casts (as!)", "high", "crashFactors", "line", False, code_has(" as!", "\tas!")),
    Check(8, "Avoid DispatchQueue.main.sync", "high", "crashFactors", "line", False, lambda n: n.code.contains(".main.sync") & ~F.concat(F.coalesce(F.col("last_code"), F.lit("")), n.code).contains("!Thread.isMainThread")),
    Check(9, "Avoid Implicitly Unwrapped Optionals (IUOs)", "medium", "crashFactors", "line", False, lambda n: ~any_of(n.raw, ["@IBOutlet", "@IBAction"]) & n.raw.rlike(r"^\s*(?:var|let)\s+\w+\s*:\s*[\w<>\[\]]+!")),
    Check(10, "Replace Deprecated openURL", "medium", "unsafeDeprecated", "line", False, code_has("openURL(")),
    Check(11, "Sensitive Data in Print / Debug Logs", "low", "insecureDataStorage", "line", True, _secret_log),
    Check(12, "Unencrypted Database (Realm / CoreData / SQLite)", "high", "insecureDataStorage", "project", True),
    Check(13, "Hardcoded Secrets in Info.plist / xcconfig", "high", "insecureDataStorage", "project"),
    Check(14, "Sensitive Responses Persisted by URLCache / WKWebView", "medium", "insecureDataStorage", "line", True, _disk_cache),
    Check(15, "fatalError / preconditionFailure in Production Code", "medium", "crashFactors", "line", True, code_has("fatalError(", "preconditionFailure(")),
    Check(16, "Dangerous C String Functions", "high", "unsafeDeprecated", "line", False, code_calls("gets(", "sprintf(", "vsprintf(", "strcpy(", "strncpy(", "strcat(", "strncat(", "scanf(", "sscanf(", "getwd(")),
    Check(17, "Weak Cryptographic Algorithm Constants (DES / 3DES / RC2 / RC4)", "high", "unsafeDeprecated", "line", False, lambda n: any_of(n.code, WEAK_ALGORITHMS) | any_of(n.raw, WEAK_NAMES)),
    Check(18, "UIWebView Usage (Deprecated, No Security Patches Since iOS 12)", "high", "unsafeDeprecated", "line", True, code_has("UIWebView")),
    Check(19, "HTTP (Non-TLS) Package Source URLs", "high", "supplyChain", "line", False, lambda n: n.path.endswith("Package.swift") & n.bare.contains(".package(url:") & n.bare.contains('"http://')),
    Check(20, "Floating / Branch Dependency Pins", "medium", "supplyChain", "line", False, lambda n: (basename(n.path) == "Package.swift") & n.code.contains(".branch(")),
    Check(21, "Unsafe Pointer Usage", "high", "memoryCorruption", "line", False, code_has("UnsafePointer<", "UnsafeMutablePointer<", "UnsafeRawPointer", "UnsafeMutableRawPointer", "withUnsafeBytes {", "withUnsafeMutableBytes {", "withUnsafePointer(", "withUnsafeMutablePointer(")),
    Check(22, "Manual Reference Counting (Unmanaged<T>)", "medium", "memoryCorruption", "line", False, code_has("Unmanaged<", ".takeRetainedValue()", ".takeUnretainedValue()", ".passRetained(", ".passUnretained(", "Int(bitPattern:", "UInt(bitPattern:")),
    Check(23, "Weak Hash Algorithm (MD5 / SHA-1)", "high", "cryptography", "line", False, _weak_hash),
    Check(24, "ECB Cipher Mode", "high", "cryptography", "line", False, code_has("kCCOptionECBMode")),
    Check(25, "Hardcoded IV / Nonce", "medium", "cryptography", "line", False, _hardcoded_iv),
    Check(26, "Hardcoded Encryption Key", "high", "cryptography", "line", True, _encryption_key),
    Check(27, "CBC Mode Without Authentication (MAC)", "high", "cryptography", "file", True, code_has("kCCModeCBC", ".cbc"), code_has("CCHmac", "HMAC", "kCCModeGCM", ".gcm", "AES.GCM", "ChaChaPoly")),
    Check(28, "Insufficient PBKDF2 Iterations", "medium", "cryptography", "line", True, lambda n: F.coalesce(F.expr(r"try_cast(regexp_extract(raw, 'CCKeyDerivationPBKDF\\s*\\([^,]+,[^,]+,[^,]+,[^,]+,[^,]+,\\s*(\\d+)', 1) AS BIGINT)") < 10_000, F.lit(False))),
    Check(29, "Plaintext HTTP URLs", "high", "networkSecurity", "line", True, _plain_url),
    Check(30, "Certificate Validation Bypass", "high", "networkSecurity", "line", False, code_has("allowsAnyHTTPSCertificate", "validatesDomainName = false", "kCFStreamSSLValidatesCertificateChain, false", ".useCredential, URLCredential(trust:")),
    Check(31, "URLSessionDelegate Challenge Bypass (unconditional useCredential)", "high", "networkSecurity", "fold", True),
    Check(32, "ATS Disabled in Info.plist (NSAllowsArbitraryLoads)", "high", "networkSecurity", "project"),
    Check(33, "WebView JavaScript Injection / Unsafe Configuration", "high", "networkSecurity", "line", True, _web_script),
    Check(34, "Hardcoded Auth Token in HTTP Header", "high", "networkSecurity", "line", True, lambda n: n.bare.contains('"Authorization"') & any_of(n.bare, ['"Bearer ', '"Basic ', '"Token '])),
    Check(35, "URLSessionConfiguration Allows Arbitrary Loads (in Code)", "high", "networkSecurity", "line", True, code_has(".allowsArbitraryLoads = true", "allowsArbitraryLoads: true")),
    Check(36, "Over-Accessible Keychain Items (kSecAttrAccessibleAlways)", "high", "authentication", "line", False, code_has("kSecAttrAccessibleAlways")),
    Check(37, "Deprecated SecTrustEvaluate (use SecTrustEvaluateWithError)", "medium", "authentication", "line", False, lambda n: n.code.contains("SecTrustEvaluate(") & ~n.code.contains("SecTrustEvaluateWithError(")),
    Check(38, "Biometric Auth Not Bound to Keychain Item", "high", "authentication", "file", False, code_has("evaluatePolicy("), code_has("SecAccessControlCreateWithFlags", ".biometryCurrentSet", ".userPresence", "kSecAttrAccessControl")),
    Check(39, "Unsafe String Interpolation in SQL Queries", "high", "ioValidation", "line", True, _sql),
    Check(40, "Insecure Deserialization (NSKeyedUnarchiver)", "high", "ioValidation", "line", False, code_has("NSKeyedUnarchiver.unarchiveObject(with:", "NSKeyedUnarchiver.unarchiveTopLevelObjectWithData(", "requiringSecureCoding: false")),
    Check(41, 'Path Traversal Risk (".." in File Paths)', "medium", "ioValidation", "line", True, _path_traversal),
    Check(42, "Shell Command Injection Risk (Process / NSTask)", "high", "ioValidation", "line", True, _shell),
    Check(43, "Debug / Diagnostic Framework in Production", "high", "binaryProtections", "line", True, lambda n: F.regexp_extract(trim(n.raw), r"^import (\S+)", 1).isin("FLEX", "Reveal", "Chisel", "InjectionIII", "Dotzu", "DBDebugToolkit", "GodEye", "Hyperion", "FLEXLoader", "RevealServer")),
    Check(44, "No Jailbreak Detection in Codebase", "medium", "binaryProtections", "project"),
    Check(45, "No Anti-Tampering Protections Found", "medium", "binaryProtections", "project"),
    Check(46, "Clipboard Data Access", "medium", "privacy", "line", True, _clipboard),
    Check(47, "Device Fingerprinting / Advertising ID", "low", "privacy", "line", True, code_has(".advertisingIdentifier", "ASIdentifierManager", ".identifierForVendor", "CTTelephonyNetworkInfo", "currentRadioAccessTechnology")),
    Check(48, "Declared Permission Without API Usage (Info.plist Mismatch)", "medium", "privacy", "project"),
    Check(49, "Crash Reporter Initialized Without Data Scrubbing", "low", "privacy", "file-all", True, code_has(*CRASH_REPORTERS), code_has(*SCRUBBING)),
    Check(50, "File Sharing / NSFileProtectionNone in Plist", "high", "iosConfiguration", "project"),
    Check(51, "NSFileProtectionNone in Swift Code", "high", "iosConfiguration", "line", False, code_has(".noProtection", "FileProtectionType.none", "NSFileProtectionNone")),
    Check(52, "Main Thread Blocking (Thread.sleep)", "medium", "logicState", "line", True, code_has("Thread.sleep(forTimeInterval:", "Thread.sleep(until:")),
    Check(53, "Notification Observer Not Removed", "low", "logicState", "file", False, code_has("NotificationCenter.default.addObserver("), code_has("removeObserver(")),
    Check(54, "Raw C Memory Operations (malloc / free / memcpy)", "high", "lowLevelBinary", "line", False, code_calls("malloc(", "calloc(", "realloc(", "free(", "memcpy(", "memmove(", "memset(", "bzero(")),
    Check(55, "Unsafe Buffer Pointer / baseAddress! Access", "medium", "lowLevelBinary", "line", False, code_has("UnsafeBufferPointer<", "UnsafeMutableBufferPointer<", "UnsafeRawBufferPointer", "UnsafeMutableRawBufferPointer", ".baseAddress!", "assumingMemoryBound(to:")),
    Check(56, "Objective-C Runtime Hazards (objc_msgSend / NSInvocation / performSelector)", "high", "lowLevelBinary", "line", True, _objc),
    Check(57, "Service-Specific Secret Prefixes (AWS / GitHub / Stripe / Slack / Google)", "high", "insecureDataStorage", "line", True, lambda n: n.raw.rlike(SERVICE_KEYS)),
    Check(58, "Private Key Committed to Source", "high", "cryptography", "line", True, lambda n: n.raw.contains("-----BEGIN") & n.raw.contains("PRIVATE KEY-----"), None, True),
    Check(59, "Catastrophic ReDoS Regex Pattern", "medium", "crashFactors", "line", False, lambda n: n.code.rlike(r"NSRegularExpression\s*\(|Regex\s*\(|\.regularExpression\b") & n.raw.rlike(NESTED_REPEAT)),
    Check(60, "Credentials in Committed .env File", "high", "insecureDataStorage", "project"),
    Check(61, "File Race Condition (Non-Atomic Write / Unprotected createFile)", "medium", "logicState", "line", True, _file_race),
    Check(62, "Unescaped HTML String Injection (XSS Risk)", "high", "ioValidation", "line", True, _html),
    Check(63, "os_log Public Format Specifier for Sensitive Value", "medium", "insecureDataStorage", "line", True, _public_log),
)
NEVER_FIRED = (60, 62)  # they couldn't fire before; compat leaves them out


#: The columns of lines that the checks look at.
LOOKED_AT = ("line_no", "raw", "code", "bare", "in_text", "last_code", "before5", "around")


def lines(files: DataFrame, *wanted: str) -> DataFrame:
    """From (file_path, text): file_path, line_no from 1, raw, code, bare and the context the checks and the style need.

    A file's lines are an array of its row, and frames are slices of it, so nothing is shuffled. Of the columns
    after file_path only the wanted ones are worked out (none named: all).
    """
    raw = F.col("raw_lines")
    rows = files.select("file_path", F.split("text", "\n", -1).alias("raw_lines"))
    code = lambda x: F.regexp_replace(x, r'"(?:\\.|[^"\\])*+"?', '""')
    bare = lambda x: F.regexp_replace(x, r'^((?:[^"/]++|"(?:\\.|[^"\\])*+"?|/(?!/))*+)//.*$', "$1")
    # lines on which a text of several lines begins or ends, from 0
    odd = F.transform(raw, lambda x, i: F.when((F.length(x) - F.length(F.replace(x, F.lit('"""'), F.lit("")))) / 3 % 2 == 1, i))
    rows = rows.withColumns({"code_lines": F.transform(raw, code), "odd_lines": F.array_compact(odd)})
    columns = {
        "line_no": lambda x, i: i + 1, "raw": lambda x, i: x, "code": lambda x, i: F.get("code_lines", i), "bare": lambda x, i: bare(x),
        "in_text": lambda x, i: F.size(F.filter("odd_lines", lambda m: m < i)) % 2 == 1, "last_code": lambda x, i: F.when(i > 0, F.get("code_lines", i - 1)),
        "before5": lambda x, i: F.lower(around(raw, i, -5, 0, "")), "around": lambda x, i: around(raw, i, -4, 5), "after5": lambda x, i: around(raw, i, 1, 5, "\n"),
    }
    wanted = wanted or tuple(columns)
    later = {"code", "raw"} <= set(wanted) and "last_code" not in wanted  # code of one line only: of the lines that a filter leaves
    each = F.transform(raw, lambda x, i: F.struct(*(columns[c](x, i).alias(c) for c in wanted if c != "code" or not later)))
    out = rows.select("file_path", F.explode(each).alias("line")).select("file_path", "line.*")
    return (out.withColumn("code", code(F.col("raw"))) if later else out).select("file_path", *wanted)


def is_test(path: Column, compat: bool) -> Column:
    """compat: any path with "test" in it; else a path with such a component or a name that ends so."""
    low = F.lower(path)
    return low.contains("test") if compat else low.rlike(r"(^|/)[a-z0-9_\-]*tests?(/|\.|$)|(^|/)tests?[_\-]")


def line_hits(lined: DataFrame, compat: bool = False) -> DataFrame:
    """(check_id, file_path, line_no, raw): all hits of line and file checks over .swift, .m, .mm and .h lines."""
    n = Line(F.col("raw"), F.col("code"), F.col("bare"), F.lower("raw"), F.col("file_path"))
    swift = F.col("file_path").endswith(".swift")
    native_too = {16, 54, 55, 56}
    test, comment = is_test(F.col("file_path"), compat), is_comment(F.col("raw"))
    found, vetoes = [], []
    for c in CHECKS:
        if c.hit is None or (compat and c.id in NEVER_FIRED):
            continue
        fits = c.hit(n)
        if not c.in_comments:
            fits = fits & ~comment
        if c.skips_tests:
            fits = fits & ~test
        if c.id not in native_too:
            fits = fits & swift
        found.append(F.when(fits, F.lit(c.id)))
        if c.veto:
            vetoes.append(F.when(c.veto(n), F.lit(c.id)))
    none = F.array().cast("array<int>")
    ids = lambda cases: F.filter(F.array(*cases), lambda x: x.isNotNull()) if cases else none
    # lines are looked at once; the few with a mark are read again below
    marked = cut(lined.select("file_path", "line_no", "raw", ids(found).alias("hits"), ids(vetoes).alias("vetoes")).filter("size(hits) > 0 OR size(vetoes) > 0"))
    hits = marked.select("file_path", "line_no", "raw", F.explode("hits").alias("check_id"))
    vetoed = marked.select("file_path", F.explode("vetoes").alias("check_id")).distinct()
    hits = hits.join(vetoed.hint("merge"), ["file_path", "check_id"], "left_anti")  # both grow with the project
    once = [c.id for c in CHECKS if c.kind == "file"]
    first = hits.filter(F.col("check_id").isin(once)).groupBy("check_id", "file_path").agg(F.min(F.struct("line_no", "raw")).alias("f")).select("check_id", "file_path", "f.line_no", "f.raw")
    return hits.filter(~F.col("check_id").isin(once)).select("check_id", "file_path", "line_no", "raw").unionByName(first)


def database_hits(lined: DataFrame, compat: bool = False) -> DataFrame:
    """Check 12: stores without protection in a file, Realm without a key in the whole project."""
    some = lined.filter(F.col("file_path").endswith(".swift") & ~is_test(F.col("file_path"), compat))
    code, raw = F.col("code"), F.col("raw")
    marks = {
        "core": any_of(raw, ["NSPersistentStoreFileProtectionKey", "NSFileProtectionComplete"]), "sqlite": any_of(raw, ["sqlite3_key(", "SQLCipher"]), "realm": raw.contains("encryptionKey"),
        "opens_core": code.contains("addPersistentStore") & ~is_comment(raw), "opens_sqlite": any_call(code, ["sqlite3_open(", "sqlite3_open_v2("]) & ~is_comment(raw), "opens_realm": code.contains("Realm(") & ~is_comment(raw),
    }
    # lines are looked at once; the few with a mark are read again below
    marked = cut(some.select("file_path", "line_no", "raw", *(m.alias(k) for k, m in marks.items())).filter(_or([F.col(k) for k in marks])))
    safe = marked.groupBy("file_path").agg(F.bool_or("core").alias("core"), F.bool_or("sqlite").alias("sqlite"))
    project = marked.agg(F.coalesce(F.bool_or("realm"), F.lit(False)).alias("realm"))
    opens = marked.filter("opens_core OR opens_sqlite OR opens_realm").drop("core", "sqlite", "realm")
    hit = (F.col("opens_core") & ~F.col("core")) | (F.col("opens_sqlite") & ~F.col("sqlite")) | (F.col("opens_realm") & ~F.col("realm"))
    return opens.join(safe.hint("merge"), "file_path").join(F.broadcast(project)).filter(hit).select(F.lit(12).alias("check_id"), "file_path", "line_no", "raw")


def challenge_hits(files: DataFrame, compat: bool = False) -> DataFrame:
    """Check 31: useCredential inside a challenge handler before any trust evaluation; a fold over a file's lines, in its row."""
    some = files.filter(F.col("file_path").endswith(".swift") & ~is_test(F.col("file_path"), compat) & F.contains("text", F.lit("didReceive challenge:")))
    code = lambda x: F.regexp_replace(x, r'"(?:\\.|[^"\\])*+"?', '""')
    rows = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("raw"), code(x).alias("code"), is_comment(x).alias("comment")))
    near = some.select("file_path", rows.alias("rows")).filter(F.exists("rows", lambda r: r["code"].contains("didReceive challenge:")))
    state = "struct<in:boolean,depth:int,entered:boolean,valid:boolean,hits:array<struct<line_no:int,raw:string>>>"
    start = F.struct(F.lit(False).alias("in"), F.lit(0).alias("depth"), F.lit(False).alias("entered"), F.lit(False).alias("valid"), F.array().cast("array<struct<line_no:int,raw:string>>").alias("hits")).cast(state)

    def step(s: Column, r: Column) -> Column:
        opens = r["code"].contains("didReceive challenge:")
        now = (s["in"] | opens) & ~r["comment"]
        fresh = opens & ~s["in"]
        count = lambda c: F.length(r["code"]) - F.length(F.replace(r["code"], F.lit(c), F.lit("")))
        depth = F.when(fresh, 0).otherwise(s["depth"]) + count("{") - count("}")
        entered = F.when(fresh, False).otherwise(s["entered"]) | r["code"].contains("{")
        valid = F.when(fresh, False).otherwise(s["valid"]) | any_of(r["code"], ["SecTrustEvaluateWithError", "SecTrustCopyExceptions", "SecPolicyCreateSSL", "SecTrustSetPolicies"])
        hit = ~valid & r["code"].contains(".useCredential")
        hits = F.when(hit, F.concat(s["hits"], F.array(F.struct(r["line_no"].alias("line_no"), r["raw"].alias("raw"))))).otherwise(s["hits"])
        after = F.struct((~(entered & (depth <= 0))).alias("in"), depth.alias("depth"), entered.alias("entered"), valid.alias("valid"), hits.alias("hits")).cast(state)
        return F.when(now, after).otherwise(s)

    return near.select("file_path", F.explode(F.aggregate("rows", start, step)["hits"]).alias("h")).select(F.lit(31).alias("check_id"), "file_path", "h.line_no", "h.raw")


def project_hits(sources: DataFrame, others: DataFrame, compat: bool = False) -> DataFrame:
    """Checks 13, 32, 44, 45, 48, 50 and 60 over source files and other files (file_path, text): plists, xcconfigs, .env."""
    rows = others.select("file_path", F.posexplode(F.split("text", "\n", -1)).alias("at", "raw")).withColumn("line_no", F.col("at") + 1)
    rows = rows.filter(~is_test(F.col("file_path"), compat))
    rows = rows.withColumn("next3", frame(F.col("raw"), ["file_path"], "line_no", 0, 2))
    plist, path, raw, low = F.col("file_path").endswith(".plist"), F.lower("file_path"), F.col("raw"), F.lower("raw")
    first = lambda df, check: df.groupBy("file_path").agg(F.min(F.struct("line_no", "raw")).alias("f")).select(F.lit(check).alias("check_id"), "file_path", "f.line_no", "f.raw")
    loads = first(rows.filter(plist & raw.contains("NSAllowsArbitraryLoads") & F.col("next3").contains("<true/>")), 32)
    shared = first(rows.filter(plist & ~any_of(path, VENDOR_PATHS) & ((raw.contains("UIFileSharingEnabled") & F.col("next3").contains("<true/>")) | raw.contains("NSFileProtectionNone"))), 50)
    value = trim(F.regexp_extract(raw, "=(.*)$", 1))
    config = F.col("file_path").endswith(".xcconfig") & any_of(low, CONFIG_KEYS) & ~any_of(raw, CONFIG_SKIP) & raw.contains("=") & (F.length(value) >= 8) & ~value.startswith("$(") & ~value.startswith("${")
    # the key on the last line that isn't blank
    filled = rows.filter(plist & (trim(raw) != "")).withColumn("last_raw", previous(raw, ["file_path"], "line_no"))
    key = F.lower(F.regexp_extract("last_raw", "<key>([^<]*)</key>", 1))
    text = F.regexp_extract(raw, "<string>([^<]*)", 1)
    keyed = filled.filter(~raw.contains("<key>") & any_of(key, CONFIG_KEYS) & raw.contains("<string>") & (F.length(text) >= 8) & ~any_of(text, CONFIG_SKIP))
    pick = lambda df, check: df.select(F.lit(check).alias("check_id"), "file_path", "line_no", "raw")
    out = loads.unionByName(shared).unionByName(pick(rows.filter(config), 13)).unionByName(pick(keyed, 13))
    if not compat:
        env = F.trim(F.regexp_extract(raw, ENV_KEY, 2))
        out = out.unionByName(pick(rows.filter(basename(F.col("file_path")).isin(*ENV_NAMES) & raw.rlike(ENV_KEY) & (env != "") & ~any_of(F.lower(env), ENV_SKIP)), 60))
    code = sources.filter(F.col("file_path").rlike(r"\.(swift|mm?)$") & ~is_test(F.col("file_path"), compat))
    absent = code.agg(F.coalesce(F.bool_or(any_of(F.col("text"), JAILBREAK) & ~F.col("file_path").endswith(".mm")), F.lit(False)).alias("a"), F.coalesce(F.bool_or(any_of(F.col("text"), ANTI_TAMPER)), F.lit(False)).alias("b"))
    for column, check, said in (("a", 44, "No jailbreak detection patterns found in the codebase."), ("b", 45, "No runtime anti-tampering protections found (anti-debug, simulator guards, tweak injection detection).")):
        out = out.unionByName(absent.filter(~F.col(column)).select(F.lit(check).alias("check_id"), F.lit("Project-wide").alias("file_path"), F.lit(0).alias("line_no"), F.lit(said).alias("raw")))
    apis = sorted({a for _, some in PERMISSIONS.values() for a in some})
    used = code.agg(*(F.coalesce(F.bool_or(F.col("text").contains(a)), F.lit(False)).alias(f"u{i}") for i, a in enumerate(apis)))
    unused = [F.when(~_or([F.col(f"u{apis.index(a)}") for a in some]), F.struct(F.lit(k).alias("key"), F.lit(label).alias("label"))) for k, (label, some) in PERMISSIONS.items()]
    unused = used.select(F.explode(F.filter(F.array(*unused), lambda x: x.isNotNull())).alias("p")).select("p.key", "p.label")
    declared = rows.filter(F.col("file_path").endswith("Info.plist")).select("file_path", "line_no", F.explode(F.array_distinct(F.regexp_extract_all(raw, F.lit("NS[A-Za-z]+UsageDescription"), F.lit(0)))).alias("key"))
    declared = declared.groupBy("file_path", "key").agg(F.min("line_no").alias("line_no")).join(F.broadcast(unused), "key")
    said = F.concat("key", F.lit(" declared but no "), "label", F.lit(" API usage found"))
    return out.unionByName(declared.select(F.lit(48).alias("check_id"), "file_path", "line_no", said.alias("raw")))


def _or(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | c
    return out


def violations(sources: DataFrame, others: DataFrame, compat: bool = False) -> DataFrame:
    """All hits: check_id, file_path, line_no, display path and snippet."""
    lined = lines(sources, *LOOKED_AT)
    hits = line_hits(lined, compat).unionByName(database_hits(lined, compat)).unionByName(challenge_hits(sources, compat)).unionByName(project_hits(sources, others, compat))
    return hits.select("check_id", "file_path", "line_no", display_path(F.col("file_path")).alias("file"), snippet(F.col("raw")).alias("snippet"))


def with_authors(hits: DataFrame, blame: DataFrame) -> DataFrame:
    """Hits with the author of their line, from blame intervals (path, first, last, author)."""
    return matching.located(hits, blame.withColumnRenamed("path", "file_path"), ["file_path"], "line_no", "first", "last")


def totals(hits: DataFrame, keys: list[str], cap: int | None = CAP) -> DataFrame:
    """(keys, total, files): hits capped per file, if a cap is given, then summed, and the number of files."""
    n = F.count("*") if cap is None else F.least(F.count("*"), F.lit(cap))
    per = hits.groupBy(*keys, "file_path").agg(n.alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("total"), F.count("*").alias("files"))


def check_results(hits: DataFrame, checks: DataFrame, cap: int | None = CAP) -> DataFrame:
    """Every check with its total (hits capped per file, if a cap is given, then summed) and number of files."""
    return checks.join(totals(hits, ["check_id"], cap), "check_id", "left").fillna(0, ["total", "files"])


def densities(results: DataFrame, keys: list[str], files: Column) -> DataFrame:
    """(keys, density, risk): totals weighted by their checks' multipliers, per file, and how they saturate."""
    density = F.coalesce(F.sum(F.col("total") * F.col("multiplier")), F.lit(0.0)) / F.greatest(F.max(files), F.lit(1))
    return results.groupBy(*keys).agg(density.alias("density")).withColumn("risk", F.col("density") / (F.col("density") + 2))


def category_scores(results: DataFrame, files: int | Column, weights: DataFrame) -> DataFrame:
    """(category, density, risk, points): weighted hits per file, saturating, times the category's weight."""
    per = densities(results, ["category"], F.lit(files) if isinstance(files, int) else files)
    out = weights.join(per, "category", "left").fillna(0.0, ["density", "risk"])
    return out.select("category", "density", "risk", F.round(F.col("risk") * F.col("weight")).cast("long").alias("points"))


def total_score(categories: DataFrame) -> DataFrame:
    """One row: the sum clamped to 0..1000, and its band."""
    total = F.greatest(F.lit(0), F.least(F.lit(1000), F.coalesce(F.sum("points"), F.lit(0))))
    band = F.when(F.col("score") < 200, "hardened").when(F.col("score") < 500, "minor").when(F.col("score") < 800, "elevated").otherwise("critical")
    return categories.agg(total.alias("score")).withColumn("band", band)


def check_table(spark) -> DataFrame:
    return spark.createDataFrame([(c.id, c.name, c.priority, c.category, MULTIPLIERS[c.priority]) for c in CHECKS], "check_id int, name string, priority string, category string, multiplier double")


def weight_table(spark) -> DataFrame:
    return spark.createDataFrame(list(WEIGHTS.items()), "category string, weight int")


def analyze(sources: DataFrame, others: DataFrame, compat: bool = False, cap: int | None = None) -> dict[str, DataFrame]:
    """violations, results, categories and score of a project; cap: hits of a check that count in one file, None for all."""
    spark = sources.sparkSession
    hits = violations(sources, others, compat)
    results = check_results(hits, check_table(spark), cap)
    swift = sources.filter("file_path LIKE '%.swift'").count()
    if not swift:
        results = results.withColumn("total", F.lit(0))
    categories = category_scores(results, swift, weight_table(spark))
    return {"violations": hits, "results": results, "categories": categories, "score": total_score(categories)}
