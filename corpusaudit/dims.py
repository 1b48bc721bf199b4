"""Fixed dictionaries and the dimension tables made from them.

Every table is a short constant list, so joining with ``F.broadcast`` never
ships anything that grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Folders and suffixes of the two scan profiles.
DISCOVERY_SUFFIXES = [
    ".py", ".java", ".js", ".ts", ".jsx", ".tsx", ".php", ".rb", ".go", ".rs", ".cpp", ".c", ".h", ".cs",
    ".swift", ".kt", ".scala", ".pl", ".r",
]
DISCOVERY_EXCLUDED = [
    "__pycache__", ".git", ".svn", "node_modules", "venv", "env", ".venv", "dist", "build", ".idea",
    ".vscode", ".pytest_cache", ".mypy_cache",
]
INDEX_EXCLUDED = ["node_modules", "venv", "__pycache__", "build", "dist"]

# Display name of a language by suffix. A lower-cased suffix is
# looked up, so the upper-case ".R" only matters to the index profile.
DISPLAY_LANGUAGES = {
    ".py": "Python",
    ".pyw": "Python",
    ".pyx": "Python (Cython)",
    ".java": "Java",
    ".js": "JavaScript",
    ".jsx": "JavaScript (React)",
    ".mjs": "JavaScript (ES Module)",
    ".cjs": "JavaScript (CommonJS)",
    ".ts": "TypeScript",
    ".tsx": "TypeScript (React)",
    ".php": "PHP",
    ".php3": "PHP",
    ".php4": "PHP",
    ".php5": "PHP",
    ".phtml": "PHP",
    ".rb": "Ruby",
    ".rbw": "Ruby",
    ".go": "Go",
    ".c": "C",
    ".h": "C/C++ Header",
    ".cpp": "C++",
    ".cc": "C++",
    ".cxx": "C++",
    ".c++": "C++",
    ".hpp": "C++ Header",
    ".hh": "C++ Header",
    ".hxx": "C++ Header",
    ".h++": "C++ Header",
    ".cs": "C#",
    ".rs": "Rust",
    ".kt": "Kotlin",
    ".kts": "Kotlin Script",
    ".swift": "Swift",
    ".scala": "Scala",
    ".sc": "Scala Script",
    ".r": "R",
    ".R": "R",
    ".pl": "Perl",
    ".pm": "Perl Module",
    ".t": "Perl Test",
    ".pod": "Perl Documentation",
    ".sh": "Shell",
    ".bash": "Bash",
    ".zsh": "Zsh",
    ".fish": "Fish Shell",
}
# Short names used when search queries are chosen.
SEARCH_LANGUAGES = {
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".cpp": "cpp",
    ".c": "c",
    ".h": "c",
    ".cs": "csharp",
    ".go": "go",
    ".rb": "ruby",
    ".php": "php",
    ".kt": "kotlin",
    ".scala": "scala",
    ".rs": "rust",
    ".swift": "swift",
}
# Short names used when tests are requested.
TEST_LANGUAGES = {
    ".py": "python",
    ".pyw": "python",
    ".pyx": "python",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
    ".php": "php",
    ".php3": "php",
    ".php4": "php",
    ".php5": "php",
    ".phtml": "php",
    ".rb": "ruby",
    ".rbw": "ruby",
    ".go": "go",
    ".c": "c",
    ".h": "c",
    ".cpp": "cpp",
    ".cc": "cpp",
    ".cxx": "cpp",
    ".c++": "cpp",
    ".hpp": "cpp",
    ".hh": "cpp",
    ".hxx": "cpp",
    ".h++": "cpp",
    ".cs": "csharp",
    ".rs": "rust",
    ".kt": "kotlin",
    ".kts": "kotlin",
    ".swift": "swift",
    ".scala": "scala",
    ".sc": "scala",
    ".r": "r",
    ".R": "r",
    ".pl": "perl",
    ".pm": "perl",
    ".t": "perl",
    ".pod": "perl",
    ".sh": "shell",
    ".bash": "shell",
    ".zsh": "shell",
    ".fish": "shell",
}
# Languages whose tests can be run, and of uploaded files.
RUNNER_LANGUAGES = {
    ".py": "python",
    ".pyw": "python",
    ".pyx": "python",
    ".java": "java",
    ".js": "javascript",
    ".jsx": "javascript",
    ".mjs": "javascript",
    ".cjs": "javascript",
    ".ts": "typescript",
    ".tsx": "typescript",
}
UPLOAD_LANGUAGES = RUNNER_LANGUAGES

#: scheme -> suffix -> language. The five schemes disagree on purpose.
LANGUAGE_SCHEMES = {
    "display": DISPLAY_LANGUAGES,
    "search": SEARCH_LANGUAGES,
    "tests": TEST_LANGUAGES,
    "runner": RUNNER_LANGUAGES,
    "upload": UPLOAD_LANGUAGES,
}
SCHEME_DEFAULTS = {"display": "Unknown", "tests": "python", "runner": "python"}
INDEX_SUFFIXES = list(LANGUAGE_SCHEMES["display"])
UPLOAD_SUFFIXES = list(LANGUAGE_SCHEMES["upload"])

# ---------------------------------------------------------------------------
# Severities with their weight and rank, highest first.
SEVERITIES = ["critical", "high", "medium", "low", "info"]
SEVERITY_WEIGHT = {"critical": 100, "high": 75, "medium": 50, "low": 25, "info": 10}
SEVERITY_RANK = {"critical": 5, "high": 4, "medium": 3, "low": 2, "info": 1}
FILE_WEIGHT_DEFAULT = 50
PATTERN_WEIGHT_DEFAULT = 25

# File categories.
CATEGORIES = ["modernize_high", "modernize_low", "skip"]

# Test framework per language.
TEST_FRAMEWORKS = {
    "python": "pytest",
    "java": "JUnit 5",
    "javascript": "Jest",
    "typescript": "Jest",
    "go": "testing package",
    "ruby": "RSpec",
    "csharp": "xUnit",
    "cpp": "Google Test",
    "kotlin": "JUnit 5",
    "scala": "ScalaTest",
}
PERFORMANCE_FRAMEWORKS = {
    "python": "pytest-benchmark",
    "java": "JMH (Java Microbenchmark Harness)",
    "javascript": "Jest (with performance hooks)",
    "typescript": "Jest (with performance hooks)",
    "go": "testing package benchmarks",
    "ruby": "Benchmark module",
    "csharp": "BenchmarkDotNet",
    "cpp": "Google Benchmark",
}

# Packages recognised in import lines.
PYTHON_PACKAGES = [
    "sqlalchemy", "pymysql", "requests", "flask", "django", "numpy", "pandas", "fastapi", "pydantic",
    "aiohttp", "httpx", "pytest",
]
SCRIPT_PACKAGES = ["express", "axios", "lodash", "moment", "react", "jest"]

# Target versions offered per language, and framework versions.
TARGET_VERSIONS = {
    "python": ["Python 3.14", "Python 3.13", "Python 3.12", "Python 3.11", "Python 3.10"],
    "java": ["Java 25 LTS", "Java 23", "Java 21 LTS", "Java 17 LTS"],
    "javascript": ["ES2025", "ES2024", "Node.js 25", "Node.js 24 LTS", "Node.js 22 LTS"],
    "typescript": ["TypeScript 5.9", "TypeScript 5.8", "TypeScript 5.7", "TypeScript 5.6"],
}
FRAMEWORK_VERSIONS = [
    "React 19", "React 18", "React 18 (Hooks)", "React 17",
    "Angular 21", "Angular 20", "Angular 19",
    "Vue 3.5", "Vue 3.4", "Vue 2.7",
    "Django 5.2 LTS", "Django 5.1", "Django 5.0",
    "Flask 3.1", "Flask 3.0", "Flask 2.3",
    "Spring Boot 4.0", "Spring Boot 3.4", "Spring Boot 3.3",
    "Laravel 12", "Laravel 11",
    "Rails 8.1", "Rails 8.0", "Rails 7.2",
    "Express 5.1", "Express 5.0", "Express 4.21",
    "FastAPI 0.122", "FastAPI 0.115",
    "Next.js 16", "Next.js 15", "Next.js 14",
]
# Frameworks whose versions are offered with a language.
LANGUAGE_FRAMEWORKS = {
    "python": ["Django", "Flask", "FastAPI"],
    "java": ["Spring"],
    "javascript": ["React", "Angular", "Vue", "Express"],
    "typescript": ["React", "Angular", "Vue", "Express"],
    "php": ["Laravel"],
    "ruby": ["Rails"],
}

# Progress shown for a phase.
PHASE_PROGRESS = {
    "Phase 1": 0.15,
    "Phase 2": 0.30,
    "Phase 3": 0.45,
    "Phase 4": 0.65,
    "Phase 5": 0.85,
}
PHASE_PROGRESS_DEFAULT = 0.5

# ---------------------------------------------------------------------------
# Search queries for every repository, then per language.
COMMON_QUERIES = [
    "Files with SQL injection vulnerabilities",
    "Files with hardcoded credentials or secrets",
    "Files with security vulnerabilities",
    "Files with deprecated API usage",
]
LANGUAGE_QUERIES = {
    "python": [
        "Files using deprecated database libraries like MySQLdb",
        "Files using Python 2 print statements",
        "Files using deprecated urllib2 library",
        "Files missing type hints",
        "Files using old-style string formatting",
    ],
    "java": [
        "Files using deprecated Java APIs like Vector or Hashtable",
        "Files using raw JDBC without prepared statements",
        "Files missing try-with-resources for AutoCloseable",
        "Files using pre-Java 8 patterns without lambdas or streams",
        "Files using deprecated Date and Calendar APIs",
        "Files with missing null checks or Optional usage",
    ],
    "javascript": [
        "Files using var instead of let or const",
        "Files using callback patterns instead of Promises or async/await",
        "Files using jQuery for DOM manipulation",
        "Files with eval() usage",
        "Files using prototype-based inheritance",
    ],
    "typescript": [
        "Files with excessive any type usage",
        "Files missing strict null checks",
        "Files using old module syntax",
    ],
    "cpp": [
        "Files using raw pointers instead of smart pointers",
        "Files with manual memory management",
        "Files using C-style casts",
        "Files missing RAII patterns",
    ],
    "csharp": [
        "Files using deprecated .NET APIs",
        "Files missing async/await patterns",
        "Files using old collection types",
    ],
    "go": [
        "Files missing error handling",
        "Files with goroutine leaks",
        "Files missing context usage",
    ],
    "ruby": [
        "Files using deprecated Ruby syntax",
        "Files missing proper error handling",
    ],
    "php": [
        "Files using deprecated mysql_* functions",
        "Files missing prepared statements",
        "Files with register_globals usage",
    ],
}

# Legacy patterns to look for, per display language.
LEGACY_PATTERNS = {
    "Python": [
        "Python 2 syntax (print statements, old-style classes)",
        "Deprecated libraries (MySQLdb, urllib2, optparse)",
        "Missing type hints",
        "Hardcoded credentials",
        "SQL injection vulnerabilities",
        "Insecure cryptography (MD5, SHA1 for passwords)",
        "Global variables and mutable defaults",
        "Missing error handling",
        "Synchronous I/O in async contexts",
    ],
    "Java": [
        "Pre-Java 8 code (no lambdas, streams)",
        "Deprecated APIs (Vector, Hashtable, Date)",
        "Missing generics",
        "Raw JDBC without ORM",
        "Synchronization issues",
        "Resource leaks (missing try-with-resources)",
        "Hardcoded configuration",
        "Missing null checks",
    ],
    "JavaScript": [
        "var instead of let/const",
        "Callback hell (no Promises/async-await)",
        "jQuery for DOM manipulation",
        "eval() usage",
        "Missing strict mode",
        "Prototype-based inheritance",
        "Global namespace pollution",
        "XSS vulnerabilities",
    ],
    "TypeScript": [
        "any type overuse",
        "Missing strict mode",
        "Old module syntax",
        "Missing null checks",
        "Implicit any",
        "Type assertions instead of guards",
    ],
    "PHP": [
        "mysql_* functions (deprecated)",
        "No prepared statements",
        "register_globals usage",
        "eval() and create_function()",
        "Missing input validation",
        "Outdated PHP version syntax",
        "No namespace usage",
        "Missing error handling",
    ],
    "Ruby": [
        "Ruby 1.8/1.9 syntax",
        "Missing bundler",
        "Deprecated gem versions",
        "Missing RSpec/Minitest",
        "Global variables",
        "Missing error handling",
        "Synchronous I/O",
    ],
    "Go": [
        "Missing error handling",
        "Deprecated packages",
        "No context usage",
        "Missing defer for cleanup",
        "Goroutine leaks",
        "Race conditions",
    ],
    "C++": [
        "Raw pointers instead of smart pointers",
        "Manual memory management",
        "Missing RAII",
        "C-style casts",
        "Missing const correctness",
        "No move semantics",
        "Deprecated C++98/03 features",
    ],
    "C#": [
        "Missing async/await patterns",
        "Old collection types",
        "Missing LINQ usage",
        "Deprecated .NET Framework APIs",
        "Missing nullable reference types",
        "Old string concatenation",
        "Missing using statements",
    ],
    "Rust": [
        "Deprecated Rust 2015/2018 syntax",
        "Missing error handling with Result",
        "Unsafe code blocks",
        "Missing lifetime annotations",
        "Deprecated crate versions",
        "Missing async/await",
    ],
    "Kotlin": [
        "Java-style code in Kotlin",
        "Missing null safety",
        "Not using coroutines",
        "Missing data classes",
        "Old collection APIs",
        "Missing extension functions",
    ],
    "Swift": [
        "Objective-C style code",
        "Missing optionals",
        "Old closure syntax",
        "Missing guard statements",
        "Deprecated Swift 4 features",
        "Missing Codable protocol",
    ],
    "Scala": [
        "Scala 2.x syntax",
        "Missing for-comprehensions",
        "Old collection APIs",
        "Missing implicit conversions",
        "Deprecated Future usage",
        "Missing case classes",
    ],
    "R": [
        "Old R syntax",
        "Missing tidyverse usage",
        "Deprecated package versions",
        "Missing pipe operators",
        "Old data.frame usage",
        "Missing ggplot2",
    ],
    "Perl": [
        "Perl 4 syntax",
        "Missing strict and warnings",
        "Old module system",
        "Deprecated CPAN modules",
        "Missing Moose/Moo",
        "Old regex syntax",
    ],
    "Shell": [
        "Missing error handling (set -e)",
        "Unquoted variables",
        "Missing shellcheck compliance",
        "Deprecated commands",
        "Missing function usage",
        "Security vulnerabilities",
    ],
}

# Lines the framework rules look for (our own choice of markers).
FRAMEWORK_MARKERS = [
    ("Django", "from django", 0.9),
    ("Flask", "from flask", 0.9),
    ("FastAPI", "from fastapi", 0.9),
    ("Spring Boot", "org.springframework", 0.9),
    ("React", "from 'react'", 0.8),
    ("React", 'from "react"', 0.8),
    ("Angular", "@angular/core", 0.9),
    ("Vue", "from 'vue'", 0.8),
    ("Express", "require('express')", 0.9),
    ("Laravel", "use Illuminate", 0.9),
    ("Rails", "ActiveRecord::Base", 0.9),
    ("Next.js", "from 'next", 0.85),
    ("jQuery", "$(document)", 0.7),
]


def target_versions() -> dict[str | None, list[str]]:
    """Versions offered per primary language; ``None`` stands for unknown."""
    offers: dict[str | None, list[str]] = {}
    for language in [*TARGET_VERSIONS, *[x for x in LANGUAGE_FRAMEWORKS if x not in TARGET_VERSIONS]]:
        own = TARGET_VERSIONS.get(language, [])
        names = LANGUAGE_FRAMEWORKS.get(language, [])
        offers[language] = own + [v for v in FRAMEWORK_VERSIONS if any(n in v for n in names)]
    everything = {v for versions in TARGET_VERSIONS.values() for v in versions}
    offers[None] = sorted(everything | set(FRAMEWORK_VERSIONS))
    return offers


def lookup(key: Column, mapping: dict[str, object]) -> Column:
    """Literal dictionary lookup; null when the key is missing."""
    pairs = [F.lit(part) for item in mapping.items() for part in item]
    return F.create_map(*pairs)[key]


def language_of(suffix: Column, scheme: str) -> Column:
    """Language of a suffix under one of the five schemes, without the default."""
    return lookup(F.lower(suffix), LANGUAGE_SCHEMES[scheme])


_SCHEMAS = {
    "languages": "scheme string, extension string, language string",
    "legacy_patterns": "language string, ord int, pattern_type string",
    "severities": "severity string, weight int, severity_rank int",
    "search_queries": "language string, ord int, query string",
    "target_versions": "language string, ord int, version string",
    "packages": "ecosystem string, ord int, package string",
    "test_frameworks": "kind string, language string, framework string",
    "framework_markers": "framework string, marker string, confidence double",
    "phases": "phase string, progress double",
}


def dimension_rows(name: str) -> list[tuple]:
    if name == "languages":
        return [(s, e, l) for s, m in LANGUAGE_SCHEMES.items() for e, l in m.items()]
    if name == "legacy_patterns":
        return [(l, i, p) for l, ps in LEGACY_PATTERNS.items() for i, p in enumerate(ps)]
    if name == "severities":
        return [(s, SEVERITY_WEIGHT[s], SEVERITY_RANK[s]) for s in SEVERITIES]
    if name == "search_queries":
        common = [(None, i, q) for i, q in enumerate(COMMON_QUERIES)]
        return common + [(l, i, q) for l, qs in LANGUAGE_QUERIES.items() for i, q in enumerate(qs)]
    if name == "target_versions":
        return [(l, i, v) for l, vs in target_versions().items() for i, v in enumerate(vs)]
    if name == "packages":
        python = [("python", i, p) for i, p in enumerate(PYTHON_PACKAGES)]
        return python + [("script", i, p) for i, p in enumerate(SCRIPT_PACKAGES)]
    if name == "test_frameworks":
        kinds = {"unit": TEST_FRAMEWORKS, "security": TEST_FRAMEWORKS, "performance": PERFORMANCE_FRAMEWORKS}
        return [(k, l, f) for k, m in kinds.items() for l, f in m.items()]
    if name == "framework_markers":
        return list(FRAMEWORK_MARKERS)
    if name == "phases":
        return list(PHASE_PROGRESS.items())
    raise KeyError(name)


def load_dimension(spark: SparkSession, name: str) -> DataFrame:
    """One of the fixed dictionaries as a table, small enough to broadcast."""
    return spark.createDataFrame(dimension_rows(name), _SCHEMAS[name])
