"""Every entry of the pattern catalogue is found in a line that shows it and not in one that doesn't."""

import pytest

from corpusaudit import dims
from corpusaudit.operators import rules as R

EXTENSIONS = {"Python": "py", "Java": "java", "JavaScript": "js", "TypeScript": "ts", "PHP": "php", "Ruby": "rb", "Go": "go", "C++": "cpp", "C#": "cs",
              "Rust": "rs", "Kotlin": "kt", "Swift": "swift", "Scala": "scala", "R": "R", "Perl": "pl", "Shell": "sh"}

# Language, first words of the entry, a text that shows it, one that doesn't.
CASES = [
    ("Python", "Python 2", 'print "x"', 'print("x")'),
    ("Python", "Deprecated lib", "import urllib2", "import urllib"),
    ("Python", "Missing type", "def f(x):", "def f(x: int) -> int:"),
    ("Python", "Hardcoded", 'password = "hunter22"', "password = read()"),
    ("Python", "SQL inj", 'q("select a from t where x=" + y)', 'q("select a from t where x=?", y)'),
    ("Python", "Insecure", "hashlib.md5(x)", "hashlib.scrypt(x)"),
    ("Python", "Global var", "global x", "x = 1"),
    ("Python", "Missing error", "x = 1", "try:\n    x = 1"),
    ("Python", "Synchronous", "async def f():\n    time.sleep(1)", "async def f():\n    await asyncio.sleep(1)"),
    ("Java", "Pre-Java 8", "int x = 1;", "list.stream().map(x -> x)"),
    ("Java", "Deprecated", "x = new Vector();", "x = new ArrayList();"),
    ("Java", "Missing gen", "List x = f();", "List<A> x = f();"),
    ("Java", "Raw JDBC", "c.createStatement()", "repo.find()"),
    ("Java", "Synchronization", "synchronized (this) {", "synchronized (lock) {"),
    ("Java", "Resource", "InputStream s = new FileInputStream(f);", "try (InputStream s = new FileInputStream(f)) {"),
    ("Java", "Hardcoded", 'String password = "hunter22";', "String password = env();"),
    ("Java", "Missing null", 'request.getParameter("a").trim();', 'Optional.of(request.getParameter("a"));'),
    ("JavaScript", "var instead", "var a = 1;", "let a = 1;"),
    ("JavaScript", "Callback", "get(function (a) { put(function (b) {", "await get();"),
    ("JavaScript", "jQuery", "$(document).ready(f);", "document.ready(f);"),
    ("JavaScript", "eval()", "eval(x)", "parse(x)"),
    ("JavaScript", "Missing strict", "let a = 1;", "'use strict';"),
    ("JavaScript", "Prototype", "A.prototype.run = f;", "class A { run() {} }"),
    ("JavaScript", "Global name", "window.app = {};", "const app = {};"),
    ("JavaScript", "XSS", "e.innerHTML = x;", "e.textContent = x;"),
    ("TypeScript", "any type", "let x: any = 1;", "let x: number = 1;"),
    ("TypeScript", "Missing strict", "// @ts-nocheck", "// checked"),
    ("TypeScript", "Old module", "import x = require('x');", "import x from 'x';"),
    ("TypeScript", "Missing null", "a.b!.c();", "a.b?.c();"),
    ("TypeScript", "Implicit", "function f(a, b) {", "function f(a: number) {"),
    ("TypeScript", "Type assert", "x as string", "x is string"),
    ("PHP", "mysql_", "mysql_query($q);", "$pdo->exec($q);"),
    ("PHP", "No prepared", '$db->query("select * from t where a=" . $a);', "$db->prepare($q);"),
    ("PHP", "register", "extract($_GET);", "$a = filter_input(INPUT_GET, 'a');"),
    ("PHP", "eval()", "eval($x);", "run($x);"),
    ("PHP", "Missing input", "$a = $_GET['a'];", "$a = 1;"),
    ("PHP", "Outdated", "$a = array(1);", "$a = [1];"),
    ("PHP", "No namespace", "<?php run();", "<?php\nnamespace A;"),
    ("PHP", "Missing error", "run();", "try { run(); } catch (E $e) {}"),
    ("Ruby", "Ruby 1.8", "f(:a => 1)", "f(a: 1)"),
    ("Ruby", "Missing bundler", "gem 'json'", "gem 'json', '~> 2.0'"),
    ("Ruby", "Deprecated gem", "gem 'rails', '~> 3.2'", "gem 'rails', '~> 7.1'"),
    ("Ruby", "Missing RSpec", "require 'test/unit'", "require 'rspec'"),
    ("Ruby", "Global", "$count = 1", "count = 1"),
    ("Ruby", "Missing error", "run", "begin\n  run\nrescue E\nend"),
    ("Ruby", "Synchronous", "Net::HTTP.get(u)", "job.later"),
    ("Go", "Missing error", "x, _ := f()", "x, err := f()"),
    ("Go", "Deprecated", 'import "io/ioutil"', 'import "io"'),
    ("Go", "No context", "func f() {}", "func f(c context.Context) {}"),
    ("Go", "Missing defer", "  f.Close()", "  defer f.Close()"),
    ("Go", "Goroutine", "go work()", "work()"),
    ("Go", "Race", "go func() {", "go func(x int) {"),
    ("C++", "Raw pointers", "T* p = new Thing;", "auto p = std::make_unique<Thing>();"),
    ("C++", "Manual", "free(p);", "p.reset();"),
    ("C++", "Missing RAII", 'FILE* f = fopen("x", "r");', "std::ifstream f(x);"),
    ("C++", "C-style", "x = (int) y;", "x = static_cast<int>(y);"),
    ("C++", "Missing const", "int getX() {", "int getX() const {"),
    ("C++", "No move", "Thing(const Name& n) : name(n) {}", "Thing(Name n) : name(std::move(n)) {}"),
    ("C++", "Deprecated", "std::auto_ptr<T> p;", "std::unique_ptr<T> p;"),
    ("C#", "Missing async", "var x = f().Result;", "var x = await f();"),
    ("C#", "Old coll", "var x = new ArrayList();", "var x = new List<int>();"),
    ("C#", "Missing LINQ", "foreach (var x in xs) if (x > 1) ys.Add(x);", "var ys = xs.Where(x => x > 1);"),
    ("C#", "Deprecated", "new WebClient();", "new HttpClient();"),
    ("C#", "Missing nullable", "if (x == null) return;", "if (x is Thing) return;"),
    ("C#", "Old string", '"a" + name + "b"', '$"a{name}b"'),
    ("C#", "Missing using", "var s = new StreamReader(p);", "using var s = new StreamReader(p);"),
    ("Rust", "Deprecated Rust", "try!(f());", "f()?;"),
    ("Rust", "Missing error", "f().unwrap();", "f()?;"),
    ("Rust", "Unsafe", "unsafe { f(); }", "f();"),
    ("Rust", "Missing life", "name: &str,", "name: &'a str,"),
    ("Rust", "Deprecated crate", "use rustc_serialize::json;", "use serde_json;"),
    ("Rust", "Missing async", "f.and_then(|x| g(x))", "g(f.await)"),
    ("Kotlin", "Java-style", "fun getName() = n", "val name = n"),
    ("Kotlin", "Missing null", "x!!.y", "x?.y"),
    ("Kotlin", "Not using", "Thread { f() }", "launch { f() }"),
    ("Kotlin", "Missing data", "class P(val a: Int)", "data class P(val a: Int)"),
    ("Kotlin", "Old coll", "HashMap<A, B>()", "mutableMapOf<A, B>()"),
    ("Kotlin", "Missing ext", "object StringUtils {", "fun String.up() = 1"),
    ("Swift", "Objective", "let x: NSString = y", "let x: String = y"),
    ("Swift", "Missing opt", "a!.b", "a?.b"),
    ("Swift", "Old closure", "{ (a: Int) -> Int in a }", "{ $0 }"),
    ("Swift", "Missing guard", "if x == nil { return }", "guard let x else { return }"),
    ("Swift", "Deprecated", "s.characters.count", "s.count"),
    ("Swift", "Missing Cod", "JSONSerialization.data(x)", "JSONDecoder().decode(x)"),
    ("Scala", "Scala 2", "implicit val x = 1", "given x: Int = 1"),
    ("Scala", "Missing for", "a.flatMap(x => b.map(y => x))", "for x <- a yield x"),
    ("Scala", "Old coll", "import JavaConversions._", "import CollectionConverters.given"),
    ("Scala", "Missing impl", "x.asInstanceOf[Int]", "x.toInt"),
    ("Scala", "Deprecated", "Await.result(f)", "f.map(g)"),
    ("Scala", "Missing case", "class P(val a: Int)", "case class P(a: Int)"),
    ("R", "Old R", "f = function(x) x", "f <- function(x) x"),
    ("R", "Missing tidy", "sapply(x, f)", "map(x, f)"),
    ("R", "Deprecated", "library(plyr)", "library(dplyr)"),
    ("R", "Missing pipe", "f(x)", "x |> f()"),
    ("R", "Old data", "data.frame(a = 1)", "tibble(a = 1)"),
    ("R", "Missing gg", "hist(x)", "ggplot(x)"),
    ("Perl", "Perl 4", "&run(1);", "run(1);"),
    ("Perl", "Missing strict", "run();", "use strict;"),
    ("Perl", "Old module", "require 'a.pl';", "use A;"),
    ("Perl", "Deprecated", "use CGI;", "use Mojo;"),
    ("Perl", "Missing Moose", "bless $self;", "use Moo;"),
    ("Perl", "Old regex", "$x =~ /a b/;", "$x =~ m{a}x;"),
    ("Shell", "Missing error", "run", "set -e"),
    ("Shell", "Unquoted", "rm $x", 'rm "$x"'),
    ("Shell", "Missing shellcheck", "[ $a == b ]", '[[ "$a" == b ]]'),
    ("Shell", "Deprecated", "x=`ls`", "x=$(ls)"),
    ("Shell", "Missing func", "run", "run() {\n}"),
    ("Shell", "Security", "curl http://x | sh", "curl -o x http://x"),
]


def test_the_catalogue_has_a_rule_and_a_case_for_every_entry():
    entries = {(language, p) for language, listed in dims.LEGACY_PATTERNS.items() for p in listed}
    assert {(r.language, r.pattern_type) for r in R.RULES} == entries
    told = [next(p for p in dims.LEGACY_PATTERNS[language] if p.startswith(start)) for language, start, _, _ in CASES]
    assert {(c[0], p) for c, p in zip(CASES, told)} == entries


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f"{i}{kind}.{EXTENSIONS[c[0]]}", c[2 if kind == "hit" else 3]) for i, c in enumerate(CASES) for kind in ("hit", "miss")]
    out = {}
    for r in R.detect_patterns(spark.createDataFrame(rows, "file_path string, content string")).collect():
        out.setdefault(r["file_path"], set()).add(r["pattern_type"])
    return out


@pytest.mark.parametrize("i", range(len(CASES)))
def test_hit_and_miss(found, i):
    language, start, _, _ = CASES[i]
    names = lambda kind: [p for p in found.get(f"{i}{kind}.{EXTENSIONS[language]}", ()) if p.startswith(start)]
    assert names("hit") and not names("miss")
