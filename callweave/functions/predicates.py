"""Predicates over symbols, files and call sites. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callweave.functions.names import annotation_name, bean_forms

#: Annotations that say a framework calls the symbol.
CALLED_BY_FRAMEWORK = [
    "Bean", "Component", "Controller", "RestController", "Service", "Repository",
    "Configuration", "Scheduled", "EventListener", "PostConstruct", "PreDestroy",
    "RequestMapping", "GetMapping", "PostMapping", "PutMapping", "DeleteMapping",
    "PatchMapping", "ExceptionHandler", "InitBinder", "ModelAttribute",
    "SqsListener", "KafkaListener", "RabbitListener", "JmsListener", "Transactional",
    "Override", "Test", "BeforeEach", "AfterEach", "BeforeAll", "AfterAll",
    "ParameterizedTest", "RepeatedTest", "Path", "GET", "POST", "PUT", "DELETE",
    "Injectable", "Module", "Get", "Post", "Put", "Delete", "Patch", "Cron",
    "SqsMessageHandler", "OnEvent", "UseGuards", "Entity",
]
#: Names that a runtime calls.
RUNTIME_NAMES = [
    "initialize", "main", "call", "to_s", "inspect", "each", "method_missing",
    "respond_to_missing?", "included", "extended", "inherited", "up", "down",
    "change", "constructor", "render", "toString", "valueOf", "default",
]
#: Fixed values: ``via`` of links that rest on a convention, and owners that are assumed.
GUESSED_VIA = ["name-convention", "unique-name", "method-missing"]
ASSUMED_OWNERS = ["js-runtime", "jdk-runtime", "Kernel"]
TYPE_KINDS = ["class", "interface", "enum", "record", "module"]
CALLABLE_KINDS = ["method", "class_method", "function"]


def is_test_path(path: Column) -> Column:
    """A test directory or a test file name; the Java suffixes mind case, the others don't."""
    return path.rlike(r"(?i)(^|/)(tests?|specs?|__tests__)/") | path.rlike(r"(Test|Tests|IT)\.java$") | path.rlike(r"(?i)_spec\.rb$|_test\.rb$|\.(test|spec)\.[cm]?[jt]sx?$")


def language_family(lang: Column) -> Column:
    """TypeScript, TSX and JavaScript call each other."""
    return F.when(lang.isin("typescript", "tsx", "javascript"), "js").otherwise(lang)


def is_generated(modifiers: Column) -> Column:
    return F.array_contains(F.coalesce(modifiers, F.array().cast("array<string>")), "generated")


def framework_marked(annotations: Column, modifiers: Column) -> Column:
    marked = F.exists(F.coalesce(annotations, F.array().cast("array<string>")), lambda a: annotation_name(a).isin(*CALLED_BY_FRAMEWORK))
    return marked | F.arrays_overlap(F.coalesce(modifiers, F.array().cast("array<string>")), F.array(F.lit("abstract"), F.lit("external")))


def is_public(name: Column, modifiers: Column) -> Column:
    known = F.coalesce(modifiers, F.array().cast("array<string>"))
    return F.arrays_overlap(known, F.array(F.lit("export"), F.lit("default"))) | ~(name.rlike("^_|^private") | F.array_contains(known, "private"))


def takes_rest(signature: Column) -> Column:
    sig = F.coalesce(signature, F.lit(""))
    return F.contains(sig, F.lit("...")) | sig.rlike(r"[(,]\s*\*")


def arity_fits(symbol_arity: Column, signature: Column, lang: Column, call_arity: Column, params: Column | None = None) -> Column:
    """Unknown counts pass, rest parameters take any number, Java is exact, the others allow fewer."""
    rest = takes_rest(signature)
    if params is not None:
        rest = rest | F.exists(F.coalesce(params, F.array().cast("array<string>")), lambda p: F.contains(p, F.lit("...")))
    return symbol_arity.isNull() | call_arity.isNull() | rest | F.when(lang == "java", call_arity == symbol_arity).otherwise(call_arity <= symbol_arity)


def accepts_arity(params: Column, arity: Column, call_arity: Column) -> Column:
    """Overload choice: the exact number, or a trailing rest parameter and at most one argument fewer."""
    rest = F.coalesce(F.endswith(F.try_element_at(params, F.lit(-1)), F.lit("...")), F.lit(False))
    return call_arity.isNull() | (arity == call_arity) | (rest & (call_arity >= arity - 1))


def open_reason(reason: Column) -> Column:
    """Not a call that is known to be another type's."""
    return reason.isNull() | ~reason.startswith("no-such-")


def in_template(name: Column, words: Column) -> Column:
    return F.arrays_overlap(bean_forms(name), words)


def edge_tier(via: Column) -> Column:
    """How well an edge is known."""
    return (
        F.when(via.isNull() | via.isin("", "direct", "constructor"), "proof").when(via.isin(*GUESSED_VIA), "guess").when(via.startswith("binding:"), "binding").otherwise("inferred")
    )


def outcome_tier(external: Column, owner: Column) -> Column:
    """How well it is known why a call has no edge."""
    return F.when((external == 1) & owner.isin(*ASSUMED_OWNERS), "assumed").when(external == 1, "proof").otherwise("miss")


def evidence_class(reason: Column, owner: Column) -> Column:
    """The four kinds that the resolution report counts library calls by."""
    return (
        F.when(owner.isin(*ASSUMED_OWNERS), "runtime built-in (assumed)")
        .when(reason.isin("external:not-in-project", "external:receiver-not-declared"), "name declared nowhere (proven)")
        .when(owner.isNotNull(), "named library (proven)")
        .otherwise("other")
    )
