"""Rule catalogue and legacy-pattern detection.

The pattern names come from the fixed list in ``dims``; which line shows a
pattern is our own definition, given by a regular expression per rule; every
entry of the list has one. A
``match`` rule reports the lines that match; an ``absent`` rule reports a file
in which the expression matches nowhere.

Detection runs inside the row of a file: no shuffle, no line explosion. A rule
first tests the whole text, so only files with a hit pay for line numbers.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusaudit import dims
from corpusaudit.functions import paths
from corpusaudit.functions.once import with_once
from corpusaudit.operators.grouping import file_key


class Rule(NamedTuple):
    language: str
    pattern_type: str
    kind: str
    regex: str
    severity: str
    confidence: float
    effort: float
    description: str
    recommendation: str
    security: str | None = None
    #: Lower-case texts of which a match holds at least one; none means unknown.
    hints: tuple[str, ...] = ()


_SECRET_WORDS = ("password", "passwd", "secret", "token", "api")
_SQL_WORDS = ("select", "insert", "update", "delete")
_SECRET = r"(?i)(password|passwd|secret|token|api_?key) *[:=]+ *[\"'][^\"']{6,}[\"']"
_SQL = r"(?i)(select|insert|update|delete) [^\"']*[\"'] *([+.%]|[|][|])"

RULES: list[Rule] = [
    Rule("Python", "Python 2 syntax (print statements, old-style classes)", "match", r"^ *print +[\"'a-zA-Z]",
         "high", 0.9, 2.0, "print statement", "call print()", hints=("print",)),
    Rule("Python", "Deprecated libraries (MySQLdb, urllib2, optparse)", "match",
         r"^ *(import|from) +(MySQLdb|urllib2|optparse)", "high", 0.95, 3.0,
         "retired library", "move to a maintained library", hints=("mysqldb", "urllib2", "optparse")),
    Rule("Python", "Missing type hints", "match", r"^ *def +[a-zA-Z0-9_]+\([a-z][^:)]*\) *:", "low", 0.6, 0.5,
         "function without type hints", "annotate parameters and result", hints=("def ",)),
    Rule("Python", "Hardcoded credentials", "match", _SECRET, "critical", 0.9, 1.0,
         "secret in source text", "read secrets from the environment", "Hardcoded credentials", hints=_SECRET_WORDS),
    Rule("Python", "SQL injection vulnerabilities", "match", _SQL, "critical", 0.85, 2.0,
         "SQL built from strings", "bind parameters", "SQL injection", hints=_SQL_WORDS),
    Rule("Python", "Insecure cryptography (MD5, SHA1 for passwords)", "match", r"hashlib[.](md5|sha1)", "high", 0.8,
         1.5, "weak hash", "use a password hash", "Insecure cryptography", hints=("hashlib.",)),
    Rule("Python", "Global variables and mutable defaults", "match",
         r"^ *(global +[a-z]|def +[a-zA-Z0-9_]+\(.*= *(\[\]|[{][}]))", "medium", 0.7, 1.0,
         "shared mutable state", "pass state explicitly", hints=("global ", "def ")),
    Rule("Python", "Missing error handling", "absent", r"^ *try *:", "low", 0.4, 1.0,
         "no try block in the file", "handle expected errors", hints=("try",)),
    Rule("Java", "Deprecated APIs (Vector, Hashtable, Date)", "match", r"new +(Vector|Hashtable|Date)\b", "medium",
         0.85, 1.5, "retired class", "use ArrayList, HashMap or java.time", hints=("vector", "hashtable", "date")),
    Rule("Java", "Raw JDBC without ORM", "match", r"(DriverManager[.]getConnection|createStatement\()", "medium", 0.7,
         3.0, "direct JDBC call", "use a repository layer", hints=("getconnection", "createstatement(")),
    Rule("Java", "Synchronization issues", "match", r"synchronized *\(this\)", "medium", 0.6, 2.0,
         "lock on this", "use a private lock", hints=("synchronized",)),
    Rule("Java", "Missing generics", "match", r"\b(List|Map|Vector|Set) +[a-z][a-zA-Z0-9]* *=", "low", 0.7, 0.5,
         "raw collection type", "add type parameters", hints=("list ", "map ", "vector ", "set ")),
    Rule("Java", "Hardcoded configuration", "match", _SECRET, "critical", 0.9, 1.0,
         "secret in source text", "read secrets from the environment", "Hardcoded credentials", hints=_SECRET_WORDS),
    Rule("Java", "Pre-Java 8 code (no lambdas, streams)", "absent", r"->|[.]stream\(", "low", 0.4, 2.0,
         "no lambda or stream", "use streams where they help", hints=("->", ".stream(")),
    Rule("JavaScript", "var instead of let/const", "match", r"(^|[ ;{(>])var +[a-zA-Z_$]", "low", 0.95, 0.25,
         "var declaration", "use let or const", hints=("var ",)),
    Rule("JavaScript", "jQuery for DOM manipulation", "match", r"([$]|jQuery)\(document\)", "medium", 0.85, 2.0,
         "jQuery call", "use DOM methods", hints=("(document)",)),
    Rule("JavaScript", "eval() usage", "match", r"\beval\(", "critical", 0.9, 1.5,
         "eval call", "parse the data instead", "Command injection", hints=("eval(",)),
    Rule("JavaScript", "Missing strict mode", "absent", r"[\"']use strict[\"']", "low", 0.5, 0.25,
         "no strict mode", "add 'use strict' or use modules", hints=("use strict",)),
    Rule("JavaScript", "Prototype-based inheritance", "match", r"[.]prototype[.][a-zA-Z_]+ *=", "medium", 0.8, 2.0,
         "prototype assignment", "use class syntax", hints=(".prototype.",)),
    Rule("JavaScript", "XSS vulnerabilities", "match", r"(innerHTML *=|document[.]write\()", "high", 0.75, 1.5,
         "unescaped output", "set text content", "Other security issues", hints=("innerhtml", "document.write(")),
    Rule("TypeScript", "any type overuse", "match", r": *any\b", "medium", 0.8, 0.5, "any type", "name the type",
         hints=("any",)),
    Rule("TypeScript", "Type assertions instead of guards", "match", r"\bas +(string|number|boolean|any)\b", "low",
         0.6, 0.5, "type assertion", "write a type guard", hints=("as ",)),
    Rule("TypeScript", "Old module syntax", "match", r"^ *(import +[a-zA-Z]+ *= *require\(|module [A-Z])", "medium",
         0.8, 1.0, "old module form", "use import and export", hints=("import ", "module ")),
    Rule("PHP", "mysql_* functions (deprecated)", "match", r"\bmysql_[a-z_]+\(", "critical", 0.95, 3.0,
         "mysql_ call", "use PDO", "SQL injection", hints=("mysql_",)),
    Rule("PHP", "eval() and create_function()", "match", r"\b(eval|create_function)\(", "critical", 0.9, 2.0,
         "code built at run time", "call a function", "Command injection", hints=("eval(", "create_function(")),
    Rule("PHP", "Missing input validation", "match", r"[$]_(GET|POST|REQUEST)\[", "high", 0.7, 1.0,
         "raw request value", "validate the input", "Other security issues", hints=("$_",)),
    Rule("PHP", "No namespace usage", "absent", r"^ *namespace +[A-Z]", "low", 0.5, 0.5,
         "no namespace", "declare a namespace", hints=("namespace ",)),
    Rule("Ruby", "Global variables", "match", r"^ *[$][a-z_]+ *=", "medium", 0.8, 1.0,
         "global variable", "pass state explicitly", hints=("$",)),
    Rule("Ruby", "Missing error handling", "absent", r"\brescue\b", "low", 0.4, 1.0, "no rescue", "handle errors",
         hints=("rescue",)),
    Rule("Go", "Deprecated packages", "match", r"\"io/ioutil\"", "medium", 0.95, 0.5,
         "retired package", "use io and os", hints=("io/ioutil",)),
    Rule("Go", "Goroutine leaks", "match", r"\bgo +[a-z][a-zA-Z]*\(", "medium", 0.5, 2.0,
         "goroutine without context", "pass a context", hints=("go ",)),
    Rule("Go", "No context usage", "absent", r"context[.]Context", "low", 0.4, 1.0, "no context", "accept a context",
         hints=("context.context",)),
    Rule("C++", "Raw pointers instead of smart pointers", "match", r"= *new +[A-Z]", "high", 0.75, 2.0,
         "owning raw pointer", "use unique_ptr", hints=("new ",)),
    Rule("C++", "Manual memory management", "match", r"\b(malloc|free|delete) *[(\[ ]", "high", 0.8, 2.0,
         "manual allocation", "use containers", hints=("malloc", "free", "delete")),
    Rule("C++", "C-style casts", "match", r"= *\((int|char|float|double|long) *[*]?\)", "low", 0.7, 0.5,
         "C-style cast", "use static_cast", hints=("= ", "=(")),
    Rule("C#", "Old collection types", "match", r"\b(ArrayList|Hashtable)\b", "medium", 0.9, 1.0,
         "untyped collection", "use generic collections", hints=("arraylist", "hashtable")),
    Rule("C#", "Old string concatenation", "match", r"\" *[+] *[a-z][a-zA-Z]* *[+] *\"", "low", 0.6, 0.25,
         "concatenated string", "interpolate", hints=("+",)),
    Rule("Rust", "Unsafe code blocks", "match", r"\bunsafe +[{]", "high", 0.95, 3.0,
         "unsafe block", "use a safe wrapper", "Other security issues", hints=("unsafe ",)),
    Rule("Rust", "Missing error handling with Result", "match", r"[.]unwrap\(\)", "medium", 0.7, 0.5,
         "unwrap call", "return the error", hints=(".unwrap()",)),
    Rule("Kotlin", "Missing null safety", "match", r"!!", "medium", 0.8, 0.5, "not-null assertion", "use safe calls",
         hints=("!!",)),
    Rule("Kotlin", "Not using coroutines", "match", r"\bThread *[({]", "medium", 0.6, 2.0, "thread", "use coroutines",
         hints=("thread",)),
    Rule("Swift", "Objective-C style code", "match", r"\bNS(String|Array|Dictionary)\b", "medium", 0.8, 1.0,
         "Objective-C type", "use Swift types", hints=("nsstring", "nsarray", "nsdictionary")),
    Rule("Swift", "Missing optionals", "match", r"[a-z]!\s*[.]", "medium", 0.6, 0.5, "forced unwrap", "use guard",
         hints=("!",)),
    Rule("Scala", "Deprecated Future usage", "match", r"Await[.]result", "medium", 0.8, 1.0, "blocking wait", "compose",
         hints=("await.result",)),
    Rule("Scala", "Old collection APIs", "match", r"JavaConversions", "high", 0.95, 1.0, "retired API", "use CollectionConverters",
         hints=("javaconversions",)),
    Rule("R", "Old R syntax", "match", r"^ *[a-zA-Z.]+ *= *function", "info", 0.6, 0.25, "assignment by =", "use <-",
         hints=("function",)),
    Rule("R", "Missing pipe operators", "absent", r"%>%|[|]>", "info", 0.4, 0.5, "no pipe", "use the pipe",
         hints=("%>%", "|>")),
    Rule("Perl", "Missing strict and warnings", "absent", r"^ *use +strict", "medium", 0.9, 0.5,
         "no strict", "use strict and warnings", hints=("strict",)),
    Rule("Perl", "Old module system", "match", r"^ *require +[\"'].*[.]pl", "medium", 0.8, 1.0, "required script", "use a module",
         hints=("require ",)),
    Rule("Shell", "Missing error handling (set -e)", "absent", r"^ *set +-[a-z]*e", "medium", 0.8, 0.25,
         "no set -e", "stop on errors", hints=("set ",)),
    Rule("Shell", "Unquoted variables", "match", r"(rm|cp|mv) +(-[a-z]+ +)?[$][a-zA-Z0-9_]+", "high", 0.75, 0.5,
         "unquoted variable", "quote it", "Command injection", hints=("$",)),
    Rule("Shell", "Deprecated commands", "match", r"`[a-z]", "low", 0.7, 0.25, "backticks", "use $( )",
         hints=("`",)),
    Rule("Python", "Synchronous I/O in async contexts", "match",
         r"^ +.*\b(time[.]sleep|requests[.](get|post|put|delete)|urllib[.]request[.]urlopen|subprocess[.](run|call))\(", "medium", 0.5, 1.5,
         "blocking call inside a function", "await an asynchronous call", hints=("time.sleep(", "requests.", "urlopen(", "subprocess.")),
    Rule("Java", "Resource leaks (missing try-with-resources)", "match",
         r"^[^(]*= *new +(FileInputStream|FileOutputStream|FileReader|FileWriter|BufferedReader|Scanner|Socket)\(", "high", 0.7, 1.5,
         "resource opened outside try", "use try-with-resources", hints=("new ",)),
    Rule("Java", "Missing null checks", "match", r"[.]get(Parameter|Attribute|Property|Header)?\([^()]*\)[.][a-z]", "medium", 0.5, 0.5,
         "call on a value that may be null", "check it or use Optional", hints=(".get",)),
    Rule("JavaScript", "Callback hell (no Promises/async-await)", "match", r"function *\([^)]*\) *[{].*function *\(|^ {8,}.*function *\(", "medium", 0.6, 2.0,
         "nested callbacks", "use promises or async functions", hints=("function",)),
    Rule("JavaScript", "Global namespace pollution", "match", r"^(window[.][a-zA-Z_$]+|[a-zA-Z_$][a-zA-Z0-9_$]*) *= *[^=]", "medium", 0.6, 1.0,
         "assignment to a global", "declare it or export it", hints=("=",)),
    Rule("TypeScript", "Missing strict mode", "match", r"// *@ts-(nocheck|ignore)|[\"']strict[\"'] *: *false", "medium", 0.8, 1.0,
         "checks turned off", "turn strict checks on", hints=("@ts-", "strict")),
    Rule("TypeScript", "Missing null checks", "match", r"[a-zA-Z0-9_)\]]![.;)\[]", "medium", 0.7, 0.5,
         "not-null assertion", "check for null", hints=("!",)),
    Rule("TypeScript", "Implicit any", "match", r"\bfunction\b[^(]*\( *[a-zA-Z_]+ *[,)]", "low", 0.7, 0.5,
         "parameter without a type", "give it a type", hints=("function",)),
    Rule("PHP", "No prepared statements", "match", r"(?i)query\( *[\"'][^\"']*[\"']? *[.]|query\( *\"[^\"]*[$]", "critical", 0.8, 2.0,
         "query built from strings", "prepare the statement", "SQL injection", hints=("query(",)),
    Rule("PHP", "register_globals usage", "match", r"register_globals|\bimport_request_variables\(|\bextract\( *[$]_", "high", 0.9, 2.0,
         "request values as globals", "read the request by name", "Other security issues", hints=("register_globals", "import_request_variables(", "extract(")),
    Rule("PHP", "Outdated PHP version syntax", "match", r"\b(ereg|eregi|split|each)\(|^ *var +[$]|<[?]( |$)|\barray\(", "medium", 0.7, 1.0,
         "syntax of old versions", "use current syntax", hints=("ereg", "split(", "each(", "var ", "<?", "array(")),
    Rule("PHP", "Missing error handling", "absent", r"\b(try|catch|set_error_handler)\b", "low", 0.4, 1.0,
         "no error handling", "handle errors", hints=("try", "catch", "set_error_handler")),
    Rule("Ruby", "Ruby 1.8/1.9 syntax", "match", r":[a-z_]+ *=> |\bputs +[\"'].*%|require *[\"']rubygems[\"']", "low", 0.7, 0.5,
         "syntax of old versions", "use current syntax", hints=("=>", "puts ", "rubygems")),
    Rule("Ruby", "Missing bundler", "match", r"^ *gem +[\"'][a-z_-]+[\"'] *$|system *\(?[\"']gem install|`gem install", "medium", 0.6, 0.5,
         "gem outside a bundle", "list it in a Gemfile with a version", hints=("gem ",)),
    Rule("Ruby", "Deprecated gem versions", "match", r"gem +[\"'](rails|activerecord)[\"'] *, *[\"'][~>=< ]*[1-4][.]", "high", 0.85, 3.0,
         "retired version of a gem", "move to a maintained version", hints=("gem ",)),
    Rule("Ruby", "Missing RSpec/Minitest", "match", r"Test::Unit|test/unit", "low", 0.8, 1.0, "retired test library", "use RSpec or Minitest",
         hints=("test::unit", "test/unit")),
    Rule("Ruby", "Synchronous I/O", "match", r"\b(Net::HTTP[.](get|post|start)|open-uri|File[.]read|IO[.]read)", "low", 0.5, 1.0,
         "blocking call", "move it to a job", hints=("net::http", "open-uri", "file.read", "io.read")),
    Rule("Go", "Missing error handling", "match", r"^[^=]*, *_ *:?= |^ *_ *= [a-zA-Z]", "medium", 0.7, 0.5, "error thrown away", "handle the error",
         hints=("_",)),
    Rule("Go", "Missing defer for cleanup", "match", r"^\s*[a-zA-Z.]+[.](Close|Unlock)\(\)", "medium", 0.6, 0.5, "cleanup without defer", "defer it",
         hints=(".close()", ".unlock()")),
    Rule("Go", "Race conditions", "match", r"\bgo +func *\( *\) *[{]", "medium", 0.5, 2.0, "goroutine over shared variables", "pass values in or lock",
         hints=("go func",)),
    Rule("C++", "Missing RAII", "match", r"\b(fopen|pthread_mutex_lock|CreateFile|socket)\(|[.]lock\(\);", "medium", 0.6, 2.0,
         "resource without an owner", "wrap it in an object", hints=("fopen(", "pthread_mutex_lock(", "createfile(", "socket(", ".lock()")),
    Rule("C++", "Missing const correctness", "match", r"\b(get|is|has)[A-Z][a-zA-Z0-9]*\( *\) *[;{]|\( *std::(string|vector<[^>]*>) *& ", "low", 0.5, 0.5,
         "accessor or reference without const", "make it const", hints=("get", "is", "has", "std::")),
    Rule("C++", "No move semantics", "match", r"[a-zA-Z_]\( *const +[A-Za-z_:]+ *& *[a-z]+ *\) *: *[a-z_]+\(", "low", 0.5, 1.0,
         "copied constructor argument", "take by value and move", hints=("const ",)),
    Rule("C++", "Deprecated C++98/03 features", "match", r"\b(auto_ptr|bind1st|bind2nd|random_shuffle|register)\b|\bthrow *\( *[A-Za-z_: ]*\) *[;{]", "medium", 0.85, 1.0,
         "feature of an old standard", "use its replacement", hints=("auto_ptr", "bind1st", "bind2nd", "random_shuffle", "register", "throw")),
    Rule("C#", "Missing async/await patterns", "match", r"[.](Result|Wait\(\)|GetAwaiter\(\)[.]GetResult\(\))", "medium", 0.7, 1.5,
         "blocking on a task", "await it", hints=(".result", ".wait()", ".getawaiter()")),
    Rule("C#", "Missing LINQ usage", "match", r"\bforeach *\(.*\) *([{] *)?(if *\(|[a-zA-Z]+[.]Add\()", "low", 0.6, 0.5, "loop that filters or copies", "use a query",
         hints=("foreach",)),
    Rule("C#", "Deprecated .NET Framework APIs", "match", r"\b(WebClient|HttpWebRequest|BinaryFormatter|System[.]Web[.]UI|Thread[.]Abort)\b", "high", 0.9, 2.0,
         "retired interface", "use its replacement", hints=("webclient", "httpwebrequest", "binaryformatter", "system.web.ui", "thread.abort")),
    Rule("C#", "Missing nullable reference types", "match", r"#nullable +disable|[!=]= *null\b", "low", 0.5, 0.5, "null handled by hand", "enable nullable types",
         hints=("null",)),
    Rule("C#", "Missing using statements", "match", r"^ *(var|[A-Z][a-zA-Z]*) +[a-z][a-zA-Z]* *= *new +(FileStream|StreamReader|StreamWriter|SqlConnection)\(", "high", 0.75, 1.0,
         "resource outside using", "declare it with using", hints=("new ",)),
    Rule("Rust", "Deprecated Rust 2015/2018 syntax", "match", r"\btry!\(|^ *extern +crate|\.\.\.[0-9]", "medium", 0.9, 0.5, "syntax of old editions", "use current syntax",
         hints=("try!(", "extern", "...")),
    Rule("Rust", "Missing lifetime annotations", "match", r"&'static +(str|\[)|: *&(str|\[[a-z0-9]+\]),", "low", 0.5, 0.5, "borrowed field", "name its lifetime",
         hints=("&",)),
    Rule("Rust", "Deprecated crate versions", "match", r"\b(rustc_serialize|failure|lazy_static)\b|extern crate (time|rand)\b", "medium", 0.8, 1.0,
         "retired crate", "use its replacement", hints=("rustc_serialize", "failure", "lazy_static", "extern crate")),
    Rule("Rust", "Missing async/await", "match", r"[.](and_then|map_err)\( *(move *)?[|]|tokio::run\(|\bthread::spawn\(", "low", 0.5, 1.5,
         "hand-made concurrency", "use async functions", hints=("and_then(", "map_err(", "tokio::run(", "thread::spawn(")),
    Rule("Kotlin", "Java-style code in Kotlin", "match", r"\bfun +(get|set)[A-Z]|; *$|[.]equals\(|\bnew +[A-Z]", "low", 0.6, 0.5, "Java idiom", "use the Kotlin one",
         hints=("fun ", ";", ".equals(", "new ")),
    Rule("Kotlin", "Missing data classes", "match", r"^ *class +[A-Z][a-zA-Z0-9]*\( *va[lr] +", "low", 0.7, 0.5, "class of values", "make it a data class", hints=("class ",)),
    Rule("Kotlin", "Old collection APIs", "match", r"\b(ArrayList|HashMap|HashSet|Arrays[.]asList)\b", "low", 0.7, 0.5, "Java collection", "use Kotlin's builders",
         hints=("arraylist", "hashmap", "hashset", "arrays.aslist")),
    Rule("Kotlin", "Missing extension functions", "match", r"\b(object|class) +[A-Z][a-zA-Z]*(Utils?|Helpers?)\b", "low", 0.7, 1.0, "class of helpers", "write extensions",
         hints=("util", "helper")),
    Rule("Swift", "Old closure syntax", "match", r"[{] *\( *[a-z]+ *: *[A-Z][^)]*\) *(-> *[A-Za-z]+ *)?in\b", "low", 0.6, 0.5, "closure spelled out", "let types be inferred",
         hints=(" in",)),
    Rule("Swift", "Missing guard statements", "match", r"\bif +[a-z][a-zA-Z]* *== *nil *[{]", "low", 0.7, 0.5, "nested check for nil", "use guard", hints=("nil",)),
    Rule("Swift", "Deprecated Swift 4 features", "match", r"\b(flatMap|index\(of:|characters[.]count|UIWebView|@UIApplicationMain)", "medium", 0.7, 0.5,
         "retired feature", "use its replacement", hints=("flatmap", "index(of:", "characters.count", "uiwebview", "@uiapplicationmain")),
    Rule("Swift", "Missing Codable protocol", "match", r"JSONSerialization|NSCoding|NSKeyedArchiver", "medium", 0.8, 1.5, "decoding by hand", "adopt Codable",
         hints=("jsonserialization", "nscoding", "nskeyedarchiver")),
    Rule("Scala", "Scala 2.x syntax", "match", r"\bimplicit +(val|def|class|object)|\bimport +[a-z.]+[.]_ *$|extends +App\b", "low", 0.8, 1.0,
         "syntax of Scala 2", "use given, extension or @main", hints=("implicit ", "._", "extends app")),
    Rule("Scala", "Missing for-comprehensions", "match", r"[.]flatMap\(.*[.](flatMap|map)\(", "low", 0.7, 0.5, "chained maps", "use a for-comprehension", hints=(".flatmap(",)),
    Rule("Scala", "Missing implicit conversions", "match", r"\basInstanceOf\[|[.]toString[.]to(Int|Long|Double)", "medium", 0.6, 0.5,
         "conversion by hand", "use a typed conversion", hints=("asinstanceof[", ".tostring.to")),
    Rule("Scala", "Missing case classes", "match", r"^ *class +[A-Z][a-zA-Z0-9]*\( *va[lr] +", "low", 0.7, 0.5, "class of values", "make it a case class", hints=("class ",)),
    Rule("R", "Missing tidyverse usage", "match", r"\b(sapply|lapply|tapply|aggregate|merge)\(", "info", 0.5, 0.5, "base function over a table", "use dplyr or purrr",
         hints=("apply(", "aggregate(", "merge(")),
    Rule("R", "Deprecated package versions", "match", r"\b(library|require)\( *[\"']?(reshape|plyr|rgdal|maptools)\b", "medium", 0.85, 1.0,
         "retired package", "use its replacement", hints=("reshape", "plyr", "rgdal", "maptools")),
    Rule("R", "Old data.frame usage", "match", r"\b(data[.]frame|read[.]csv)\(|stringsAsFactors", "info", 0.6, 0.5, "base table", "use a tibble",
         hints=("data.frame(", "read.csv(", "stringsasfactors")),
    Rule("R", "Missing ggplot2", "match", r"\b(plot|hist|barplot|boxplot)\(", "info", 0.6, 1.0, "base graphics", "use ggplot2", hints=("plot(", "hist(")),
    Rule("Perl", "Perl 4 syntax", "match", r"(^|[^&])&[a-z_]+\(|\blocal *\([$]|'[a-z]+'[a-z]+\(", "medium", 0.7, 1.0, "syntax of Perl 4", "use current syntax",
         hints=("&", "local", "'")),
    Rule("Perl", "Deprecated CPAN modules", "match", r"\buse +(CGI|Switch|Error|Class::DBI|LWP::Simple)\b", "medium", 0.85, 2.0, "retired module", "use its replacement",
         hints=("use ",)),
    Rule("Perl", "Missing Moose/Moo", "match", r"\bbless +[$({]|@ISA *=", "low", 0.8, 1.5, "object made by hand", "use Moo or Moose", hints=("bless", "@isa")),
    Rule("Perl", "Old regex syntax", "match", r"=~ */[^/]*/[a-wyz]* *[;)]|[$]&", "low", 0.5, 0.25, "expression without /x", "spell it out with /x", hints=("=~", "$&")),
    Rule("Shell", "Missing shellcheck compliance", "match", r"\[ +[$][a-zA-Z_]+ +==? |\bfor +[a-z]+ +in +[$]\(ls|\bcat +[^|]*[|] *grep", "low", 0.7, 0.25,
         "construct that shellcheck reports", "follow its advice", hints=("[ $", "for ", "cat ")),
    Rule("Shell", "Missing function usage", "absent", r"^ *(function +)?[a-zA-Z_][a-zA-Z0-9_]* *\( *\)", "info", 0.4, 0.5, "no function", "split the script", hints=("()", "( )")),
    Rule("Shell", "Security vulnerabilities", "match", r"\beval +|(curl|wget) [^|]*[|] *(sudo +)?(ba)?sh\b|chmod +(-R +)?777", "critical", 0.85, 1.5,
         "command from outside, or open rights", "check what is run", "Command injection", hints=("eval ", "curl ", "wget ", "chmod ")),
]

#: Rules that apply to a file of any language, known or not.
TEXT_RULES: list[Rule] = [
    Rule("*", "Hardcoded credentials", "match", _SECRET, "critical", 0.9, 1.0,
         "secret in text", "read secrets from the environment", "Hardcoded credentials", hints=_SECRET_WORDS),
    Rule("*", "Inline script variable", "match", r"<script>[^<]*\bvar +[a-z]", "low", 0.8, 0.25,
         "inline var", "move scripts to files", hints=("<script>",)),
    Rule("*", "License line", "match", r"(?i)\blicen[sc]e\b", "info", 0.5, 0.0, "license text", "keep",
         hints=("licence", "license")),
]


def java_regex(rule: Rule) -> str:
    """Line ends are newlines only and ``^`` matches at each of them."""
    return "(?dm)" + rule.regex


_PATTERN_FIELDS = (
    "pattern_type:string,severity:string,description:string,line_numbers:array<int>,"
    "confidence:double,recommendation:string,estimated_effort_hours:double,kind:string,security_class:string"
)
FINDING = f"array<struct<{_PATTERN_FIELDS}>>"


def _quoted(value: str | None) -> str:
    """A Spark SQL string literal."""
    return "NULL" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _finding(content: str, rule: Rule) -> str:
    """The finding of one rule as SQL text over ``content`` and ``t``, its lower-case form and lines; null without a hit."""
    regex = _quoted(java_regex(rule))
    hit = f"{content} RLIKE {regex}"
    if rule.hints:
        # A plain search is many times faster than the expression it rules out.
        hit = "(" + " OR ".join(f"contains(t.lower, {_quoted(h)})" for h in rule.hints) + f") AND {hit}"
    if rule.kind == "absent":
        hit, line_numbers = f"NOT ({hit})", "CAST(array() AS array<int>)"
    else:
        numbered = f"transform(t.lines, (l, i) -> CASE WHEN l RLIKE {regex} THEN i + 1 END)"
        line_numbers = f"filter({numbered}, n -> n IS NOT NULL)"
    return f"""CASE WHEN {hit} THEN named_struct('pattern_type', {_quoted(rule.pattern_type)},
        'severity', {_quoted(rule.severity)}, 'description', {_quoted(rule.description)}, 'line_numbers', {line_numbers},
        'confidence', {rule.confidence}D, 'recommendation', {_quoted(rule.recommendation)},
        'estimated_effort_hours', {rule.effort}D, 'kind', {_quoted(rule.kind)},
        'security_class', CAST({_quoted(rule.security)} AS string)) END"""


def findings(language: str, content: str, rules: Sequence[Rule] | None = None) -> Column:
    """Array of findings of one file, in catalogue order, from two columns by name.

    The catalogue becomes one expression text, which is parsed much faster than
    thousands of column calls are made.
    """
    by_language: dict[str, list[Rule]] = {}
    for rule in RULES if rules is None else rules:
        by_language.setdefault(rule.language, []).append(rule)

    def found(group: Sequence[Rule]) -> str:
        array = ", ".join(_finding(content, r) for r in group)
        # The one-element transform names the lower-cased text and the lines, so they are made once.
        named = f"transform(array(named_struct('lower', lower({content}), 'lines', split({content}, '\\n'))), t -> array({array}))[0]"
        return f"filter({named}, p -> p IS NOT NULL AND (p.kind = 'absent' OR size(p.line_numbers) > 0))"

    nothing = f"CAST(array() AS {FINDING})"
    cases = [f"WHEN {_quoted(name)} THEN {found(group)}" for name, group in by_language.items() if name != "*"]
    chosen = f"CASE {language} {' '.join(cases)} ELSE {nothing} END" if cases else nothing
    general = found(by_language["*"]) if "*" in by_language else nothing
    return F.expr(f"CAST(concat({chosen}, {general}) AS {FINDING})")


def with_language(files: DataFrame, scheme: str = "display") -> DataFrame:
    """Add ``language`` from the suffix of ``file_path``."""
    language = dims.language_of(paths.suffix(F.col("file_path")), scheme)
    default = dims.SCHEME_DEFAULTS.get(scheme)
    return files.withColumn("language", F.coalesce(language, F.lit(default)) if default else language)


def rules_for(files: DataFrame, base_language: bool = False) -> DataFrame:
    """Legacy patterns to check per file; a language without an entry has none.

    ``base_language`` also gives variants such as ``JavaScript (React)`` the
    patterns of the language before the bracket (off by default).
    """
    spark = files.sparkSession
    key = F.col("language")
    if base_language:
        key = F.coalesce(F.nullif(F.regexp_extract(key, r"^(\S+) \(", 1), F.lit("")), key)
    patterns = dims.load_dimension(spark, "legacy_patterns").withColumnRenamed("language", "rule_language")
    return (
        with_language(files)
        .withColumn("rule_language", key)
        .join(F.broadcast(patterns), "rule_language")
        .drop("rule_language")
    )


def detect_nested(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """Files with ``language`` and a ``patterns`` array; one narrow pass."""
    return with_once(with_language(files), "patterns", findings("language", "content", rules))


def detect_patterns(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per file and pattern found, over all lines of the whole text."""
    named = with_language(files)
    keys = [c for c in named.columns if c != "content"]
    return named.select(
        *keys, F.explode(findings("language", "content", rules)).alias("p")
    ).select(*keys, "p.*").drop("kind", "security_class")


def security_findings(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """One row per file, vulnerability and line, from the security rules only."""
    rules = [r for r in (RULES if rules is None else rules) if r.security]
    named = with_language(files)
    return (
        named.select(*file_key(files), F.explode(findings("language", "content", rules)).alias("p"))
        .select(
            *file_key(files),
            F.col("p.security_class").alias("vulnerability"),
            F.col("p.severity").alias("severity"),
            F.explode("p.line_numbers").alias("line_number"),
            F.col("p.description").alias("description"),
            F.col("p.recommendation").alias("recommendation"),
        )
    )


def security_scores(files: DataFrame, rules: Sequence[Rule] | None = None) -> DataFrame:
    """0-100 per file: a quarter of the weight of each kind of finding is lost."""
    rules = [r for r in (RULES if rules is None else rules) if r.security]
    return detect_nested(files, rules).select(
        *file_key(files),
        F.size("patterns").cast("bigint").alias("n_kinds"),
        modern_score(F.col("patterns")).alias("security_score"),
    )


def modern_score(patterns: Column) -> Column:
    """``max(0, 100 - sum(weight / 4 * confidence))`` over a patterns array."""
    from corpusaudit.functions.severity import weight

    lost = F.aggregate(
        patterns,
        F.lit(0.0),
        lambda acc, p: acc + weight(p["severity"], dims.PATTERN_WEIGHT_DEFAULT) / 4 * p["confidence"],
    )
    return F.greatest(F.lit(0.0), F.round(100 - lost, 4))
