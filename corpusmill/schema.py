"""Row types of the engine: texts, tokens, pages, sites and URL indexes."""

from pyspark.sql import types as T

PARAGRAPH_START, SENTENCE_START, NO_SPACE, ABBR, PUNCT, TITLECASE, UPPERCASE, NUMERIC, UNRECOGNIZED = (1 << k for k in range(9))

_TYPES = {"int": T.IntegerType(), "long": T.LongType(), "string": T.StringType(), "strings": T.ArrayType(T.StringType()), "map": T.MapType(T.StringType(), T.StringType())}


def struct(fields: str) -> T.StructType:
    """A type from "name kind, name kind"; unlike a DDL string it needs no session."""
    return T.StructType([T.StructField(n, _TYPES[k]) for n, k in (f.split() for f in fields.split(", "))])


TOKEN = struct("flags int, form string, lemma string, pos string, head int, deprel string")
TEXT = struct("text_id string, language strings, text string").add("tokens", T.ArrayType(TOKEN))
PAGE = struct("id long, status int, url string, ip string, headers map, content string, redirect_count int, site_md5 string, path_md5 string")
SITE = struct("site_md5 string, scheme int, host string, port int, ip string, ip_expires long, robots_expires long, allow strings, disallow strings")
URL = struct("site_md5 string, path_md5 string, url string")
INDEX = struct("site_md5 string, path_md5 string, modified long, size long, checksum long")
PATH_STATE = struct("site_md5 string, path_md5 string, path_status string, error_count int, last_update long, last_modified long, history long, size long, checksum long")
