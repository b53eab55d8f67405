"""Structure of Java sources: a lexer and a parser of declarations, run on batches of files.

Recognised are top-level types with their members. A file that can't be read to its end gives the types before that
place. Package names are whole, sealed classes are told apart, constructors, enum methods and varargs are included, and
a documentation comment belongs to the declaration right behind it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.functions import text as X

_TOKEN = re.compile(
    r'(?P<space>\s+)|(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)|(?P<string>"""(?:\\.|[^\\])*?(?:"""|\Z)|"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))'
    r"|(?P<char>'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z))|(?P<word>[^\W\d]\w*(?:\$\w*)*|\$\w*)|(?P<number>\d[\w.]*)|(?P<op>&&|\|\||->|::|\.\.\.|.)",
    re.DOTALL,
)

MODIFIERS = frozenset("public private protected static final abstract synchronized native strictfp default".split())
SOFT = frozenset("sealed transient volatile".split())
PRIMITIVES = frozenset("byte short int long char float double boolean void".split())
KINDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
PAIRS = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    #: The last comment before it, where nothing else stands between.
    comment: str | None = None


def tokens(source: str) -> list[Token]:
    """All tokens but white space and comments; a token keeps the comment right before it."""
    out, comment = [], None
    for m in _TOKEN.finditer(source):
        kind = m.lastgroup
        if kind == "comment":
            comment = m[0]
        elif kind != "space":
            out.append(Token(kind, m[0], m.start(), m.end(), comment))
            comment = None
    return out


def string_literals(source: str) -> list[tuple[int, str]]:
    """Line, from 1, and text in quotes of each string literal."""
    out, line, at = [], 1, 0
    for t in tokens(source):
        if t.kind == "string":
            line, at = line + source.count("\n", at, t.start), t.start
            out.append((line, t.text))
    return out


@dataclass
class Head:
    modifiers: list[str] = field(default_factory=list)
    annotations: list[str] = field(default_factory=list)
    values: list[str | None] = field(default_factory=list)
    sealed: bool = False
    comment: str | None = None


class End(Exception):
    pass


class Parser:
    def __init__(self, source: str):
        self.source, self.t, self.i = source, tokens(source), 0

    def at(self, k: int = 0) -> str:
        return self.t[self.i + k].text if self.i + k < len(self.t) else ""

    def need(self) -> Token:
        if self.i >= len(self.t):
            raise End
        return self.t[self.i]

    def skip_pair(self) -> None:
        """Over a bracketed part that begins here."""
        close = [PAIRS[self.need().text]]
        self.i += 1
        while close:
            x = self.need()
            if x.kind == "op":
                if x.text in PAIRS:
                    close.append(PAIRS[x.text])
                elif x.text == close[-1]:
                    close.pop()
            self.i += 1

    def skip_angles(self) -> None:
        depth = 0
        while True:
            x = self.need().text
            depth += (x == "<") - (x == ">")
            self.i += 1
            if not depth:
                return

    def slice(self, a: int, b: int) -> str:
        return self.source[self.t[a].start : self.t[b - 1].end].replace("\n", " ").strip() if b > a else ""

    def head(self) -> Head:
        h = Head(comment=self.need().comment)
        while True:
            x = self.need()
            if x.text == "@" and self.at(1) != "interface":
                self.i += 1
                first = self.i
                while self.at(1) == ".":
                    self.i += 2
                name = "".join(t.text for t in self.t[first : self.i + 1])
                self.i += 1
                value, plain = None, "." not in name
                if self.at() == "(":
                    a = self.i
                    self.skip_pair()
                    value = next((t.text.strip('"') for t in self.t[a : self.i] if t.kind == "string"), None)
                    if not plain:
                        continue
                h.annotations.append(name)
                h.values.append(value)
            elif x.text in MODIFIERS and not (x.text == "default" and self.at(1) in (":", "->")):
                h.modifiers.append(x.text)
                self.i += 1
            elif x.text in SOFT and self.t[self.i + 1 : self.i + 2] and self.t[self.i + 1].kind == "word":
                h.sealed |= x.text == "sealed"
                self.i += 1
            elif x.text == "non" and self.at(1) == "-" and self.at(2) == "sealed":
                self.i += 3
            else:
                return h

    def type_name(self) -> str:
        """A type: its text. Names with dots, arguments in angles, and arrays."""
        a = self.i
        while self.at() == "@":
            self.i += 2
        if self.need().kind != "word":
            raise End
        self.i += 1
        while True:
            if self.at() == "<":
                self.skip_angles()
            elif self.at() == "." and self.i + 1 < len(self.t):
                self.i += 2
            elif self.at() == "[" and self.at(1) == "]":
                self.i += 2
            else:
                return self.slice(a, self.i)

    def type_list(self) -> list[str]:
        out = [self.type_name()]
        while self.at() == ",":
            self.i += 1
            out.append(self.type_name())
        return out

    def starts_type(self) -> bool:
        x = self.at()
        if x in ("class", "interface", "enum") or x == "@" and self.at(1) == "interface":
            return True
        return x == "record" and self.i + 2 < len(self.t) and self.t[self.i + 1].kind == "word" and self.at(2) in ("(", "<")

    def declaration(self, h: Head) -> dict:
        if self.at() == "@":
            self.i += 1
            kind = "annotation"
        else:
            kind = KINDS[self.at()]
        if h.sealed and kind == "class":
            kind = "sealed_class"
        self.i += 1
        name = self.need().text
        self.i += 1
        if self.at() == "<":
            self.skip_angles()
        if self.at() == "(":
            self.skip_pair()
        extends, implements = None, []
        while self.need().text != "{":
            word = self.at()
            self.i += 1
            if word == "extends":
                names = self.type_list()
                extends = names[0] if kind in ("class", "sealed_class") else None
            elif word == "implements":
                implements = self.type_list()
            elif word == "permits":
                self.type_list()
        methods, deps = self.body(name, kind)
        if kind == "annotation":
            methods, deps = [], []
        return {
            "name": name,
            "kind": kind,
            "annotations": h.annotations,
            "annotation_values": h.values,
            "extends": extends,
            "implements": implements,
            "javadoc": doc(h.comment),
            "dependencies": deps,
            "methods": methods,
        }

    def constants(self) -> None:
        """Over the constants of an enum."""
        while self.need().text not in (";", "}"):
            if self.at() in PAIRS:
                self.skip_pair()
            else:
                self.i += 1
        if self.at() == ";":
            self.i += 1

    def body(self, owner: str, kind: str) -> tuple[list[dict], list[str]]:
        self.i += 1
        methods, deps = [], []
        if kind == "enum":
            self.constants()
        while self.need().text != "}":
            if self.at() == ";":
                self.i += 1
                continue
            h = self.head()
            if self.at() == "{":
                self.skip_pair()
            elif self.starts_type():
                deps += self.declaration(h)["dependencies"]
            else:
                self.member(owner, h, methods, deps)
        self.i += 1
        return methods, deps

    def member(self, owner: str, h: Head, methods: list[dict], deps: list[str]) -> None:
        if self.at() == "<":
            self.skip_angles()
        if self.at() == owner and self.at(1) in ("(", "{"):
            returns, name = "void", owner
            self.i += 1
        else:
            returns = self.type_name()
            name = self.need().text
            self.i += 1
        if self.at() == "(":
            parameters = self.parameters()
        elif self.at() == "{" and name == owner:
            parameters = []
        else:
            while self.need().text != ";":
                if self.at() in PAIRS:
                    self.skip_pair()
                else:
                    self.i += 1
            self.i += 1
            if ("final" in h.modifiers or "Autowired" in h.annotations) and returns not in PRIMITIVES:
                deps.append(returns)
            return
        a = self.i
        while self.need().text not in ("{", ";"):
            if self.at() in ("(", "["):
                self.skip_pair()
            elif self.at() == "default" and self.at(1) == "{":
                self.i += 1
                self.skip_pair()
            else:
                self.i += 1
        if self.at() == "{":
            a = self.i
            self.skip_pair()
            cc = complexity(self.t[a : self.i])
        else:
            self.i += 1
            cc = 1
        methods.append({"name": name, "return_type": returns, "parameters": parameters, "modifiers": h.modifiers, "annotations": h.annotations, "annotation_values": h.values, "javadoc": doc(h.comment), "cyclomatic_complexity": cc})

    def parameters(self) -> list[str]:
        end = self.i
        self.skip_pair()
        end, self.i = self.i - 1, end + 1
        out = []
        while self.i < end:
            self.head()
            kind = self.type_name()
            while self.at() == "@":
                self.i += 2
            if self.at() == "...":
                kind += "..."
                self.i += 1
            if self.need().kind == "word" and self.at() != "this":
                out.append(f"{kind} {self.at()}")
            while self.i < end and self.at() != ",":
                self.i += 1
            self.i += 1
        self.i = end + 1
        return out


def doc(comment: str | None) -> str | None:
    return comment.strip() if comment and comment.startswith("/**") else None


def complexity(body: list[Token]) -> int:
    """One and the decision points: if, for, while (a do has one), catch, ternaries, && and ||, groups of case labels,
    arrows of a switch, and guards."""
    n = 1
    texts = [t.text for t in body]
    label = group_open = False
    depth = 0
    for i, t in enumerate(body):
        x = t.text
        if t.kind == "op":
            if x in ("&&", "||"):
                n += 1
            elif x == "?":
                before, after = texts[i - 1] if i else "", texts[i + 1] if i + 1 < len(texts) else ""
                if not (before in ("<", ",") and after in (">", ",", "extends", "super")):
                    n += 1
            elif label and depth == 0 and x in (":", "->"):
                if x == "->" or not group_open:
                    n += 1
                label, group_open = False, x == ":"
                continue
            if label:
                depth += (x in "([{") - (x in ")]}")
        elif t.kind == "word":
            if x in ("if", "for", "while", "catch"):
                n += 1
            elif x == "case" or x == "default" and i + 1 < len(texts) and texts[i + 1] in (":", "->"):
                label, depth = True, 0
                continue
            elif x == "when" and label:
                n += 1
        if not label:
            group_open = False
    return n


def parse(source: str) -> tuple[str, list[dict]]:
    """The package, empty if there is none, and the top-level types in source order."""
    p = Parser(source)
    package, types = "", []
    try:
        while p.i < len(p.t):
            if p.at() == "package":
                a = p.i + 1
                while p.need().text != ";":
                    p.i += 1
                package = "".join(t.text for t in p.t[a : p.i])
                p.i += 1
            elif p.at() == "import":
                while p.need().text != ";":
                    p.i += 1
                p.i += 1
            else:
                start = p.i
                h = p.head()
                if p.starts_type():
                    types.append(p.declaration(h))
                elif p.at() in PAIRS:
                    p.skip_pair()
                else:
                    p.i = max(p.i, start) + 1
    except (End, IndexError, KeyError):
        pass
    return package, types


_METHOD = pa.struct(
    [
        ("name", pa.string()),
        ("return_type", pa.string()),
        ("parameters", pa.list_(pa.string())),
        ("modifiers", pa.list_(pa.string())),
        ("annotations", pa.list_(pa.string())),
        ("annotation_values", pa.list_(pa.string())),
        ("javadoc", pa.string()),
        ("cyclomatic_complexity", pa.int32()),
    ]
)
_CLASS = pa.schema(
    [
        ("file_path", pa.string()),
        ("class_ord", pa.int32()),
        ("package", pa.string()),
        ("name", pa.string()),
        ("kind", pa.string()),
        ("annotations", pa.list_(pa.string())),
        ("annotation_values", pa.list_(pa.string())),
        ("extends", pa.string()),
        ("implements", pa.list_(pa.string())),
        ("javadoc", pa.string()),
        ("loc", pa.int32()),
        ("dependencies", pa.list_(pa.string())),
        ("methods", pa.list_(_METHOD)),
    ]
)
_DDL_METHOD = "struct<name string, return_type string, parameters array<string>, modifiers array<string>, annotations array<string>, annotation_values array<string>, javadoc string, cyclomatic_complexity int>"
_DDL_CLASS = (
    "file_path string, class_ord int, package string, name string, kind string, annotations array<string>, annotation_values array<string>, extends string, "
    f"implements array<string>, javadoc string, loc int, dependencies array<string>, methods array<{_DDL_METHOD}>"
)


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content, loc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            package, types = parse(content or "")
            rows += [{"file_path": path, "class_ord": k, "package": package, "loc": loc} | t for k, t in enumerate(types)]
        yield pa.RecordBatch.from_pylist(rows, schema=_CLASS)


def _value(names, values, wanted):
    hits = F.filter(F.arrays_zip(names.alias("n"), values.alias("v")), lambda x: x["n"].isin(*wanted) & x["v"].isNotNull())
    return F.get(F.transform(hits, lambda x: x["v"]), F.lit(0))


def parse_files(files: DataFrame) -> DataFrame:
    """One row for each top-level type of files (path, content): its structure, role, base path and methods with verbs and paths.

    Only path, content and the line count go to Python; everything that follows from names is an expression."""
    sent = files.select("path", "content", X.lines_of_code(F.col("content")).cast("int").alias("loc"))
    raw = sent.mapInArrow(_classes, _DDL_CLASS)
    verbs = tuple(X.VERB_BY_ANNOTATION)
    method = lambda m: F.struct(
        m["name"].alias("name"),
        X.signature(m["modifiers"], m["return_type"], m["name"], m["parameters"]).alias("signature"),
        m["return_type"].alias("return_type"),
        m["parameters"].alias("parameters"),
        m["modifiers"].alias("modifiers"),
        m["annotations"].alias("annotations"),
        m["javadoc"].alias("javadoc"),
        X.http_verb(m["annotations"]).alias("http_method"),
        F.when(X.http_verb(m["annotations"]).isNotNull(), _value(m["annotations"], m["annotation_values"], verbs)).alias("http_path"),
        m["cyclomatic_complexity"].alias("cyclomatic_complexity"),
    )
    return raw.select(
        "file_path",
        "class_ord",
        "package",
        "name",
        F.concat_ws(".", X.blank_to_null(F.col("package")), "name").alias("qualified_name"),
        "kind",
        X.role_of(F.col("annotations"), F.col("name"), F.col("kind")).alias("role"),
        X.module_of(F.col("package")).alias("module"),
        "annotations",
        "extends",
        "implements",
        _value(F.col("annotations"), F.col("annotation_values"), ("RequestMapping",)).alias("base_path"),
        "javadoc",
        "loc",
        "dependencies",
        F.transform("methods", method).alias("methods"),
    )


def explode_methods(classes: DataFrame) -> DataFrame:
    """One row for each method: its class's key columns and its own, with method_ord."""
    own = classes.select("file_path", "class_ord", F.col("name").alias("class_name"), "qualified_name", "role", "module", "base_path", F.posexplode("methods").alias("method_ord", "m"))
    return own.select(*(c for c in own.columns if c != "m"), "m.*")


def literals(files: DataFrame) -> DataFrame:
    """path, line, value, with quotes: the string literals of files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, line, value) for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for line, value in string_literals(content or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string()))], ["path", "line", "value"])

    return files.select("path", "content").mapInArrow(run, "path string, line int, value string")
