"""Scalar expressions over source texts, names and paths. All are built from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5

#: Role by annotation; fixed values.
ROLE_BY_ANNOTATION = {
    "RestController": "controller",
    "Controller": "controller",
    "Service": "service",
    "Repository": "repository",
    "Entity": "entity",
    "Configuration": "configuration",
    "Component": "component",
    "ControllerAdvice": "exception_handler",
    "RestControllerAdvice": "exception_handler",
}

#: HTTP verb by mapping annotation, in order of precedence; fixed values.
VERB_BY_ANNOTATION = {
    "GetMapping": "GET",
    "PostMapping": "POST",
    "PutMapping": "PUT",
    "DeleteMapping": "DELETE",
    "PatchMapping": "PATCH",
    "RequestMapping": "REQUEST",
}

#: Verbs that a method's name may begin with, in order of precedence; fixed values.
VERB_PREFIXES = {
    "get": "Retrieves",
    "add": "Creates",
    "create": "Creates",
    "update": "Updates",
    "delete": "Deletes",
    "find": "Finds",
    "search": "Searches for",
    "login": "Authenticates",
    "to": "Converts to",
}

#: Parts of a message that show a refused login; fixed values, compared without case and literally.
AUTH_MARKERS = (
    "Authentication failed",
    "could not read Username",
    "terminal prompts disabled",
    "403",
    "401",
    "Invalid username or password",
    "remote: Repository not found",
    "fatal: repository.*not found",
    "Permission denied",
)


def lines(content: Column) -> Column:
    """Array of the lines of a text; \\r\\n and \\r end a line too, and an end at the very end begins no further one."""
    plain = F.regexp_replace(content, "\r\n?", "\n")
    parts = F.split(plain, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines_of_code(content: Column) -> Column:
    """Lines that aren't blank."""
    return F.size(F.filter(F.split(content, "\n"), lambda x: x.rlike(r"\S")))


def estimate_tokens(text: Column, chars_per_token: float = CHARS_PER_TOKEN) -> Column:
    return (F.length(text) / F.lit(float(chars_per_token))).cast("int") + 1


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def _path_parts(*parts: Column) -> Column:
    kept = F.filter(F.array(*(F.coalesce(p, F.lit("")) for p in parts)), lambda p: p != "")
    return F.array_join(F.transform(kept, lambda p: F.trim(p, F.lit("/"))), "/")


def endpoint_path(base: Column, path: Column) -> Column:
    """A slash, and the parts that aren't empty joined by slashes, without those at their ends."""
    return F.concat(F.lit("/"), _path_parts(base, path))


def flow_path(base: Column, path: Column) -> Column:
    """As endpoint_path, but a slash goes before it only if there is none."""
    joined = _path_parts(base, path)
    return F.when(F.startswith(joined, F.lit("/")), joined).otherwise(F.concat(F.lit("/"), joined))


def http_endpoint(verb: Column, base: Column, path: Column) -> Column:
    """Verb, space, then each part that isn't empty with one slash before it; null without a verb."""
    one = lambda p: F.when(F.coalesce(p, F.lit("")) != "", F.concat(F.lit("/"), F.trim(p, F.lit("/")))).otherwise("")
    return F.when(verb.isNotNull(), F.trim(F.concat(verb, F.lit(" "), one(base), one(path))))


def module_of(package: Column) -> Column:
    """services and the segment behind it; else common or config if there is such a segment; else the package."""
    parts = F.split(package, r"\.")
    at = F.array_position(parts, "services").cast("int")
    return (
        F.when(at > 0, F.array_join(F.slice(parts, at, 2), "."))
        .when(F.array_contains(parts, "common"), "common")
        .when(F.array_contains(parts, "config"), "config")
        .otherwise(F.coalesce(blank_to_null(package), F.lit("(default)")))
    )


def role_of(annotations: Column, name: Column, kind: Column) -> Column:
    """By the first annotation that has a role; else by the first rule that the name meets."""
    table = F.create_map(*(F.lit(x) for pair in ROLE_BY_ANNOTATION.items() for x in pair))
    known = F.filter(annotations, lambda a: a.isin(*ROLE_BY_ANNOTATION))
    by_annotation = F.when(F.size(known) > 0, F.element_at(table, F.get(known, 0)))
    ends = lambda *xs: name.rlike(f"({'|'.join(xs)})$")
    has = lambda *xs: name.rlike("|".join(xs))
    by_name = (
        F.when(ends("Repository", "RepositoryImpl"), "repository")
        .when(has("Dto", "DTO"), "dto")
        .when(ends("Mapper"), "mapper")
        .when(ends("Assembler"), "assembler")
        .when(ends("Converter"), "converter")
        .when(has("Security", "Auth", "Jwt", "Token"), "security")
        .when(has("Exception"), "exception")
        .when(ends("Util", "Utils", "Helper"), "util")
        .when(kind == "record", "record")
        .when(has("Config"), "config")
        .otherwise("model")
    )
    return F.coalesce(by_annotation, by_name)


def http_verb(annotations: Column) -> Column:
    """The first verb in order of precedence, whatever the order of annotations."""
    return F.coalesce(*(F.when(F.array_contains(annotations, a), v) for a, v in VERB_BY_ANNOTATION.items()))


def signature(modifiers: Column, return_type: Column, name: Column, parameters: Column) -> Column:
    return F.trim(F.concat(F.array_join(modifiers, " "), F.lit(" "), return_type, F.lit(" "), name, F.lit("("), F.array_join(parameters, ", "), F.lit(")")))


def redact(value: Column) -> Column:
    """Three stars for up to eight characters; of longer values the first four and last two stay."""
    return F.when(F.length(value) <= 8, "***").otherwise(F.concat(F.substring(value, 1, 4), F.lit("***"), F.right(value, F.lit(2))))


def describe_method(name: Column, sig: Column) -> Column:
    """A sentence from the verb that a name begins with and its words; else its declaration."""
    out = None
    for prefix, verb in VERB_PREFIXES.items():
        rest = F.coalesce(blank_to_null(F.substr(name, F.lit(len(prefix) + 1))), F.lit("resource"))
        said = F.concat(F.lit(verb + " "), F.trim(F.lower(F.regexp_replace(rest, "([A-Z])", " $1"))), F.lit("."))
        hit = F.startswith(name, F.lit(prefix))
        out = F.when(hit, said) if out is None else out.when(hit, said)
    return out.otherwise(F.concat(F.lit("Implements `"), name, F.lit("` as declared: "), sig, F.lit(".")))


def cache_key(*parts: Column) -> Column:
    return F.left(F.sha2(F.concat_ws("||", *parts), 256), F.lit(24))


def token_cost(tokens_in: Column, tokens_out: Column, cached: Column, in_price: float = 3.0, out_price: float = 15.0) -> Column:
    """Cost for prices of a million tokens; 0 where a cached answer was used."""
    return F.when(cached, 0.0).otherwise((tokens_in * in_price + tokens_out * out_price) / 1e6)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def test_stem(path: Column) -> Column:
    """Base name without its last suffix, in lower case, without test and tests."""
    stem = F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")
    return F.trim(F.regexp_replace(F.lower(stem), "tests?", ""))


def repository_stem(name: Column) -> Column:
    out = name
    for part in ("Repository", "Impl", "Custom"):
        out = F.replace(out, F.lit(part), F.lit(""))
    return F.lower(out)


def entity_stem(path: Column) -> Column:
    return F.lower(F.replace(base_name(path), F.lit("Entity.java"), F.lit("")))


def without_generics(type_name: Column) -> Column:
    return F.trim(F.substring_index(type_name, "<", 1))


def repo_slug(url: Column) -> Column:
    """The last two parts of a repository's address, joined by a hyphen; slashes at the end and .git don't count."""
    plain = F.regexp_replace(F.regexp_replace(url, "/+$", ""), r"\.git$", "")
    parts = F.split(F.replace(plain, F.lit(":"), F.lit("/")), "/")
    return F.when(F.size(parts) >= 2, F.concat(F.get(parts, F.size(parts) - 2), F.lit("-"), F.element_at(parts, -1))).otherwise(F.get(parts, F.lit(0)))


def is_auth_error(message: Column) -> Column:
    low = F.lower(message)
    out = F.lit(False)
    for marker in AUTH_MARKERS:
        out = out | F.contains(low, F.lit(marker.lower()))
    return out


def resolve_model(name: Column, current: list[str], aliases: dict[str, str], default: str) -> Column:
    """A model's present name: blank gives the default; known names and aliases, also without a date at the end; else itself."""
    plain = F.trim(F.coalesce(name, F.lit("")))
    table = F.create_map(*(F.lit(x) for pair in ({c: c for c in current} | aliases).items() for x in pair))
    return F.when(plain == "", default).otherwise(F.coalesce(F.try_element_at(table, plain), F.try_element_at(table, F.regexp_replace(plain, r"-202\d{5}$", "")), plain))


def api_error_class(message: Column, code: Column) -> Column:
    """not_found, auth, rate_limit, overloaded, server or other: the first that message or status code show."""
    low, code = F.lower(message), F.coalesce(code, F.lit(0))
    has = lambda c, *xs: c.rlike("|".join(xs))
    return (
        F.when(has(message, "404", "not_found_error") | (code == 404), "not_found")
        .when(has(message, "401", "authentication_error") | (code == 401), "auth")
        .when(has(message, "429") | (code == 429) | has(low, "rate_limit"), "rate_limit")
        .when(has(message, "529") | has(low, "overloaded"), "overloaded")
        .when(has(message, "500") | (code == 500), "server")
        .otherwise("other")
    )


def is_truncation_error(message: Column) -> Column:
    """Whether a failure means that an answer was cut off."""
    low = F.lower(message)
    has = lambda x: F.contains(low, F.lit(x))
    return has("max_tokens") | (has("field required") & has("classes")) | (has("validation error") & has("chunksights")) | has("returned none") | has("schema not satisfied") | has("truncated")


def complexity_band(cc: Column) -> Column:
    return F.when(cc <= 4, "simple").when(cc <= 10, "moderate").otherwise("complex")


def recommended_output_tokens(max_tokens: Column) -> Column:
    return (max_tokens * 0.6).cast("int")


def title(c: Column) -> Column:
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def progress_kind(message: Column) -> Column:
    """warning for progress texts that begin with a warning sign or speak of a warning, failure or heuristic, else info."""
    return F.when(F.lower(message).rlike("^\u26a0|warning|failed|heuristic"), "warning").otherwise("info")


def clean_key(key: Column, placeholders: tuple[str, ...] = ("your-key-here", "")) -> Column:
    """A key without white space around it; empty for null and for what only stands in for one."""
    plain = F.trim(F.coalesce(key, F.lit("")))
    return F.when(plain.isin(*placeholders), "").otherwise(plain)


def with_credentials(url: Column, token: Column) -> Column:
    """An http address with a token before its host; as it is without one."""
    has = F.coalesce(token, F.lit("")) != ""
    return F.when(has & url.rlike("^https?://"), F.concat(F.regexp_extract(url, "^(https?://)", 1), token, F.lit("@"), F.regexp_replace(url, "^https?://", ""))).otherwise(url)


def clock_time(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "HH:mm:ss")


def now_iso() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def progress(done: Column, total: Column, start: float = 0.42, share: float = 0.40) -> Column:
    return start + done / F.greatest(total, F.lit(1)) * share
