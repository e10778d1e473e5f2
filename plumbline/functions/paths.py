"""What the path of a file says about it, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes, markers and names by which paths are classified.
DOC_SUFFIXES = [".md", ".mdx", ".rst", ".adoc", ".textile"]
CODE_SUFFIXES = [".py", ".pyi", ".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".rb", ".c", ".h", ".cc", ".cpp", ".hpp", ".cs", ".php", ".swift", ".m", ".mm"]
GENERATED = ["node_modules/", "vendor/", "third_party/", "thirdparty/", "site-packages/", "dist/", "build/", "_build/", ".tox/", "target/", "generated/", "_generated/", "autogen/", "docs/api/", "api-reference/", "apiref/", "javadoc/", "godoc/", ".venv/", "venv/", "site/"]
PROCESS_STEMS = ["changelog", "changes", "history", "news", "releases", "release-notes", "license", "licence", "copying", "notice", "patents", "authors", "contributors", "maintainers", "codeowners", "owners", "code_of_conduct", "code-of-conduct", "security", "support", "funding", "governance", "roadmap"]
TEST_DIRS = ["test/", "tests/", "spec/", "__tests__/", "testdata/", "fixtures/"]
TEST_NAMES = ["test_", "_test.", ".test.", ".spec.", "conftest."]
GENERIC_WORDS = ["api", "src", "lib", "docs", "doc", "documentation", "guide", "guides", "index", "readme", "readme_md", "main", "core", "utils", "util", "common", "base", "misc", "internal", "advanced", "usage", "reference", "overview", "intro", "introduction", "quickstart", "tutorial", "tutorials", "examples", "example", "test", "tests", "init", "py", "md", "rst", "txt", "source"]
COSMETIC = ["typo", "typos", "spelling", "misspell", "grammar", "punctuation", "capitali", "whitespace", "trailing", "indent", "formatting", "reformat", "lint", "prettier", "markdownlint", "rephrase", "reword", "wording", "broken link", "dead link", "fix link", "fix links", "update link", "bump", "changelog", "release notes", "version number", "translat", "i18n", "l10n"]


def any_of(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(p) for p in parts))


def name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The last dotted part of the name, lower-cased; none for dot files."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    """The name without its suffix, lower-cased."""
    return F.lower(F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", ""))


def is_generated(path: Column) -> Column:
    return any_of(F.lower(path), GENERATED)


def is_test(path: Column) -> Column:
    low = F.lower(path)
    return any_of(low, TEST_DIRS) | any_of(name(low), TEST_NAMES)


def kind(path: Column) -> Column:
    """doc, code or other."""
    return (
        F.when(is_generated(path), "other")
        .when(suffix(path).isin(*DOC_SUFFIXES), F.when(stem(path).isin(*PROCESS_STEMS), "other").otherwise("doc"))
        .when(suffix(path).isin(*CODE_SUFFIXES), F.when(is_test(path), "other").otherwise("code"))
        .otherwise("other")
    )


def is_cosmetic(subject: Column) -> Column:
    return any_of(F.lower(subject), COSMETIC)


def documents_code(path: Column) -> Column:
    return ~any_of(F.lower(path), [*TEST_DIRS, ".github/"])


def words(path: Column) -> Column:
    """Distinct words of three letters and more that are not generic."""
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_WORDS)))


def related(doc: Column, code: Column) -> Column:
    return (stem(doc) == stem(code)) | (F.size(F.array_intersect(words(doc), words(code))) > 0)


def _tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), "[-._/]+"), lambda w: F.length(w) >= 4))


def path_tokens(path: Column) -> Column:
    """Distinct words of four letters and more of directories and stem."""
    return _tokens(F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", ""))


def stem_tokens(path: Column) -> Column:
    return _tokens(stem(path))


def file_safe(slug: Column) -> Column:
    return F.regexp_replace(slug, "[^A-Za-z0-9._-]+", "__")
