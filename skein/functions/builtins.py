"""Names that a language or its standard library brings along: references to them stay unresolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names by language.
JS = (
    "console window document global process Promise Array Object String Number Boolean Date Math JSON RegExp Error Map Set "
    "setTimeout setInterval clearTimeout clearInterval fetch require module exports __dirname __filename"
).split()
JS_OBJECTS = "console Math JSON".split()
REACT_HOOKS = "useState useEffect useContext useReducer useCallback useMemo useRef useLayoutEffect useImperativeHandle useDebugValue".split()
PYTHON = "print len range str int float list dict set tuple open input type isinstance hasattr getattr setattr super self cls None True False".split()
PYTHON_TYPES = "list dict set tuple str int float bool bytes bytearray frozenset object super".split()
PYTHON_METHODS = (
    "append extend insert remove pop clear sort reverse copy update keys values items get add discard union intersection difference "
    "split join strip lstrip rstrip replace lower upper startswith endswith find index count encode decode format isdigit isalpha isalnum "
    "read write readline readlines close flush seek"
).split()
GO = (
    "make new len cap append copy delete close panic recover print println complex real imag error nil true false iota int int8 int16 int32 int64 "
    "uint uint8 uint16 uint32 uint64 uintptr float32 float64 complex64 complex128 string bool byte rune any"
).split()
GO_PACKAGES = (
    "fmt os io net http log math sort sync time path bytes strings strconv errors context json xml csv html template regexp reflect runtime "
    "testing flag bufio crypto encoding filepath hash mime rand signal sql syscall unicode unsafe atomic binary debug exec heap ring scanner "
    "tar zip gzip zlib tls url user pprof trace ast build parser printer token types cgo plugin race ioutil utilruntime utilwait utilnet"
).split()

WEB = ("typescript", "javascript", "tsx", "jsx")


def is_builtin(name: Column, language: Column) -> Column:
    """Built in whatever the project defines."""
    head = F.regexp_extract(name, r"^([^.]+)\.", 1)
    return (
        F.when(language.isin(*WEB), name.isin(*JS, *REACT_HOOKS) | head.isin(*JS_OBJECTS))
        .when(language == "python", name.isin(*PYTHON) | head.isin(*PYTHON_TYPES))
        .when(language == "go", name.isin(*GO) | head.isin(*GO_PACKAGES))
        .when(language.isin("c", "cpp"), name.startswith("std::"))
        .otherwise(False)
    )


def without_builtins(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References less those to built-ins, and less methods of Python's own types unless the project has
    that name, or for `receiver.method` a type called like the receiver."""
    names = nodes.select(F.col("name").alias("_known")).distinct()
    kept = refs.filter(~is_builtin(F.col("reference_name"), F.col("language")))
    part = lambda i: F.regexp_extract("reference_name", r"^(?:([^.]+)\.)?(.*)$", i)
    unsure = (F.col("language") == "python") & part(2).isin(*PYTHON_METHODS)
    receiver = part(1)
    asked = F.when(receiver == "", part(2)).otherwise(F.concat(F.upper(F.substring(receiver, 1, 1)), F.expr("substring(regexp_extract(reference_name, '^(?:([^.]+)[.])?', 1), 2)")))
    checked = kept.filter(unsure).withColumn("_known", asked).join(names, "_known", "left_semi").drop("_known")
    return kept.filter(~unsure).unionByName(checked)
