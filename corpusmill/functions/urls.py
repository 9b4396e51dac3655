"""Identity of URLs: parts, hashes, canonical form and resolution."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashes import md5_64

NONE, HTTP, HTTPS = 0, 1, 2


def no_fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^([^#]*)", 1)


def scheme(url: Column) -> Column:
    s = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    return F.when(s == "http", HTTP).when(s == "https", HTTPS).otherwise(NONE)


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def username(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r"^([^:@]*)(?::[^@]*)?@", 1)


def password(url: Column) -> Column:
    return F.regexp_extract(_authority(url), r"^[^:@]*:([^@]*)@", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(_authority(url), r"(?:^|@)([^:@]*)(?::[0-9]*)?$", 1))


def port(url: Column) -> Column:
    """The port in use, with the scheme's default where none is given."""
    given = F.regexp_extract(_authority(url), r":([0-9]+)$", 1)
    return F.when(given != "", given.try_cast("int")).when(scheme(url) == HTTPS, 443).when(scheme(url) == HTTP, 80).otherwise(0)


def path(url: Column) -> Column:
    """Path and query; the path is at least a slash."""
    p = F.regexp_extract(no_fragment(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$", 1)
    return F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit("/"), p))


def parse(url: Column) -> Column:
    return F.struct(scheme(url).alias("scheme"), username(url).alias("username"), password(url).alias("password"), host(url).alias("host"), port(url).alias("port"), path(url).alias("path"))


def compose(p: Column) -> Column:
    """The URL of parse()'s parts; a default port is left out."""
    name = F.when(p["scheme"] == HTTPS, "https://").otherwise("http://")
    user = F.when(p["username"] == "", "").when(p["password"] == "", F.concat(p["username"], F.lit("@"))).otherwise(F.concat(p["username"], F.lit(":"), p["password"], F.lit("@")))
    default = ((p["scheme"] == HTTP) & (p["port"] == 80)) | ((p["scheme"] == HTTPS) & (p["port"] == 443))
    return F.concat(name, user, p["host"], F.when(default, "").otherwise(F.concat(F.lit(":"), p["port"].cast("string"))), p["path"])


def site_md5(url: Column) -> Column:
    """Identity of scheme, host and port, as hex."""
    return md5_64(F.concat_ws(" ", scheme(url).cast("string"), host(url), port(url).cast("string")))


def path_md5(url: Column) -> Column:
    return md5_64(path(url))


def with_identity(pages: DataFrame, url: str = "url") -> DataFrame:
    return pages.withColumn("site_md5", site_md5(F.col(url))).withColumn("path_md5", path_md5(F.col(url)))


def with_scheme(url: Column) -> Column:
    """http:// is put before a URL without a scheme."""
    u = F.trim(url)
    return F.when(u.rlike(r"^[A-Za-z]+://"), u).otherwise(F.concat(F.lit("http://"), u))


@F.pandas_udf(T.StringType())
def _resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    def one(b: str | None, x: str | None) -> str | None:
        if x is None or b is None:
            return x
        try:
            return urljoin(b, x)
        except ValueError:
            return x

    return pd.Series([one(b, x) for b, x in zip(base, link, strict=True)], dtype=object)


def absolutise(base: Column, link: Column) -> Column:
    """link seen from base; links with a scheme, or a root path, stay in the JVM."""
    x = F.trim(link)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    whole, rooted = F.contains(x, F.lit("://")), x.rlike(r"^/[^/]") & ~F.contains(x, F.lit("/.")) & (root != "")
    rest = F.when(~F.coalesce(whole | rooted, F.lit(False)), x)  # Python gets all rows, whatever the condition: only these with a link
    return F.when(whole, x).otherwise(F.when(rooted, F.concat(root, x)).otherwise(_resolved(base, rest)))
