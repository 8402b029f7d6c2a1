"""Keyword and path vocabularies used by the metric catalogue.

Matching is substring search on the lower-cased text, OR-combined; each set
compiles to one regular expression so the test is a single ``rlike``.
"""

from __future__ import annotations

import re

# --- Fixed values: keyword sets and extension lists of the reference ---
BUG_KEYWORDS = ["bug", "fix", "issue", "patch", "error", "defect",
                "fixes", "issues", "defects", "errors", "bugfixes"]
REFACTOR_KEYWORDS = ["refactor", "cleanup", "restructure", "optimize"]
IMPROVEMENT_KEYWORDS = ["refactor", "optimize", "enhance", "update"]
PULL_REQUEST_KEYWORDS = ["pull request", "merge request"]
COAUTHOR_KEYWORDS = ["co-author", "co-authors", "co-authored-by", "pair programming"]

# extension -> language
LANGUAGE_EXTENSIONS = [
    ("java", "Java"),
    ("py", "Python"),
    ("js", "JavaScript/TypeScript"), ("jsx", "JavaScript/TypeScript"),
    ("ts", "JavaScript/TypeScript"), ("tsx", "JavaScript/TypeScript"),
    ("cs", "C#"),
    ("rb", "Ruby"),
    ("go", "Golang"),
    ("sql", "SQL"),
    ("rs", "Rust"),
    ("swift", "Swift"),
    ("kt", "Kotlin"), ("kts", "Kotlin"),
    ("sh", "Shell Scripts"),
    ("c", "C/C++"), ("cpp", "C/C++"), ("h", "C/C++"), ("hpp", "C/C++"),
    ("html", "HTML/CSS"), ("htm", "HTML/CSS"), ("css", "HTML/CSS"),
    ("md", "Markdown"),
]

CONFIG_EXTENSIONS = ["conf", "cfg", "ini", "yaml", "yml", "json", "xml",
                     "properties", "toml", "env"]

CONFIG_KEYWORDS = ["config files", "settings", "setup files"]

# build files by name, by ending, and (%) by ending of the name
BUILD_NAMES = ["pom.xml", "build.gradle", "package.json", "requirements.txt", "yarn.lock", "Gemfile",
               "Gemfile.lock", "Cargo.toml", "Podfile", "Podfile.lock"]
BUILD_ENDINGS = [".csproj", ".sln", ".xcodeproj", ".gradle", "lock.json", "lock.yaml", "lock.yml"]

# skill -> extensions; testing skill is the is_test_file flag
SKILL_EXTENSIONS = [
    ("backend", ["java", "cs", "py", "rb", "go", "rs", "cpp", "c"]),
    ("sql", ["sql", "ddl", "dml", "pks", "pkb"]),
    ("frontend", ["html", "css", "js", "jsx", "ts", "tsx"]),
]
SKILLS = ["backend", "sql", "frontend", "testing"]

# GitHub Actions workflow files (tool presence example)
GITHUB_ACTIONS_GLOBS = [".github/workflows/*.yml", ".github/workflows/*.yaml"]
# --- end of fixed values ---


def keyword_regex(words: list[str]) -> str:
    """Regex matching any of the words as a substring (already lower-case)."""
    # longer words first is unnecessary for a boolean test; keep given order
    return "|".join(re.escape(w) for w in dict.fromkeys(words))


def glob_to_regex(glob: str) -> str:
    """Translate a SQL GLOB pattern (case-sensitive; * ? [..]) to an anchored
    regex, so GLOB filters run as ``rlike``."""
    out, i = [], 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = glob.find("]", i + 1)
            if j < 0:
                out.append(re.escape(ch))
            else:
                body = glob[i + 1:j]
                if body.startswith("^"):
                    body = "^" + body[1:]
                out.append("[" + body + "]")
                i = j
        else:
            out.append(re.escape(ch))
        i += 1
    return "^" + "".join(out) + "$"
