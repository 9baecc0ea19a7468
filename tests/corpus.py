"""A small repository, written for these tests."""

import subprocess
from pathlib import Path

FILES = {
    "Packages/Shop/Package.swift": '// swift-tools-version: 5.9\nimport PackageDescription\nlet package = Package(name: "Shop", platforms: [.iOS(.v16), .macOS(.v13_1)], dependencies: [.package(url: "http://git.invalid/x", .branch("main"))])\n',
    "Packages/Shop/Sources/Shop/CartModel.swift": """import Foundation
import struct Catalog.Price

/// Holds what a visitor buys.
/// One per visit.
public final class CartModel: Purchasable, Codable {
    enum State { case empty, full(Int) }
    static let shared = CartModel()
    var lines: [CartLine] = []
    // TODO: discounts
    // FIXME: rounding
    func total() -> Int { lines.count }
    func slowest(_ a: [Int]) -> [Int] {
        var a = a
        for i in 0..<a.count {
            for j in 0..<(a.count - i - 1) {
                if a[j] > a[j+1] {
                    a.swapAt(j, j + 1)
                }
            }
        }
        return a
    }
}

struct CartLine { let sku: String; var count: Int }
protocol Purchasable { func total() -> Int }
protocol Marked {}
extension Purchasable {
    func half() -> Int { total() / 2 }
}
actor CartStore { var saved: [CartModel] = [] }
enum Tender { case card(String), cash }
""",
    "Packages/Shop/Sources/Shop/CartViewModel.swift": """import Combine
import SwiftUI
final class CartViewModel: ObservableObject {
    @Published var cart = CartModel.shared
    lazy var client = ShopClient()
    func binarySearch(_ a: [Int], _ x: Int) -> Int { 0 }
    func lookup(_ values: [Int], wanted: Int) -> Int? {
        var low = 0, high = values.count - 1
        while low <= high {
            let mid = low + (high - low) / 2
            if values[mid] == wanted { return mid }
            if values[mid] < wanted { low = mid + 1 } else { high = mid - 1 }
        }
        return nil
    }
}
""",
    "Packages/Shop/Sources/Shop/ShopClient.swift": """import Foundation
class ShopClient {
    let apiKey = "9f8a7b6c5d4e3f2a1b0c"
    let base = "http://shop.example.org:8080/v1"
    let feed = "wss://feed.example.org/live" // "http://commented.example.org/x"
    func load() {
        let data = try! Data(contentsOf: URL(string: base)!)
        DispatchQueue.main.sync { print("token", data) }
        // let hidden = "http://hidden.example.org/y"
    }
    func query(id: String) { db.run("SELECT * FROM t WHERE id = \\(id)") }
}
""",
    "Packages/Tree/Sources/Tree/SearchTree.swift": """final class TreeNode {
    var left: TreeNode?
    var right: TreeNode?
    var label: String { "x" }
}
final class SearchTree {
    private var root: TreeNode?
    var depth = 0
    func insert(_ node: TreeNode) { root = node }
}
struct Holder { var tree: SearchTree }
struct Wider { var holder: Holder }
indirect enum Expr { case add(Expr, Expr), value(Int) }
struct CardStack { var body: some View { Text("push pop") } }
func fnv(_ d: [UInt8]) -> UInt32 { var h: UInt32 = 0x811c_9dc5; for b in d { h = (h ^ UInt32(b)) &* 0x0100_0193 }; return h }
""",
    "App/Tests/CartTests.swift": 'import XCTest\nimport Shop\nfinal class CartTests: XCTestCase { func testIt() { let x = try! go() } }\n',
    "App/AuthHandler.swift": """class Trusting: NSObject, URLSessionDelegate {
    func urlSession(_ s: URLSession, didReceive challenge: URLAuthenticationChallenge, completionHandler: (Int, Int) -> Void) {
        completionHandler(.useCredential, 1)
    }
}
class Careful: NSObject, URLSessionDelegate {
    func urlSession(_ s: URLSession, didReceive challenge: URLAuthenticationChallenge, completionHandler: (Int, Int) -> Void) {
        guard SecTrustEvaluateWithError(t, nil) else { return }
        completionHandler(.useCredential, 1)
    }
}
class Base: NSObject { }
class Middle: Base { override func go() {} }
class Leaf: Middle { }
""",
    "App/Legacy.m": '#import <UIKit/UIKit.h>\n#import "SDK/Thing.h"\n#import "Legacy.h"\n@import CoreData;\n@interface Legacy : NSObject\n@end\nvoid f() { char *p = malloc(3); objc_msgSend(p); }\n',
    "App/Info.plist": "<plist><dict>\n<key>NSAllowsArbitraryLoads</key>\n<true/>\n<key>NSCameraUsageDescription</key>\n<string>we look</string>\n<key>clientSecret</key>\n<string>abcdefghijkl</string>\n</dict></plist>\n",
    "App/.env": "API_KEY=realvalue123\nTOKEN=changeme\n",
    "App/pic.png": "x" * 2000,
    "App/zlib/a.c": "int a;\n" * 30,
    "App/zlib/b.c": "int b;\n" * 30,
    "Pods/Skipped/Skipped.swift": "class Skipped {}\n",
}


def write(root: Path) -> str:
    for name, text in FILES.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    return str(root)


def commit(root: str) -> None:
    """Three commits of two authors, and a merge."""

    def git(*args, when=1_700_000_000):
        env = {"GIT_AUTHOR_DATE": f"{when} +0000", "GIT_COMMITTER_DATE": f"{when} +0000", "HOME": root, "PATH": "/usr/bin:/bin"}
        subprocess.run(["git", "-C", root, "-c", "user.name=Ann", "-c", "user.email=ann@x.org", *args], check=True, capture_output=True, env=env)

    day = 86400
    git("init", "-q", "-b", "main")
    git("add", "-A")
    git("commit", "-qm", "feat(cart): begin", when=1_700_000_000)
    git("checkout", "-qb", "feature/one")
    Path(root, "App/AuthHandler.swift").open("a").write("// more\n")
    git("commit", "-qam", "fix: more", "--author", "Bob <bob@x.org>", when=1_700_000_000 + day)
    git("checkout", "-q", "main")
    Path(root, "Packages/Shop/Sources/Shop/ShopClient.swift").open("a").write("// tail\n")
    git("commit", "-qam", "Revert something", when=1_700_000_000 + 2 * day)
    git("merge", "-q", "--no-ff", "-m", "Merge one", "feature/one", when=1_700_000_000 + 3 * day)
    git("tag", "v1.10.0")
    git("tag", "v1.9.0")
    git("tag", "note")
