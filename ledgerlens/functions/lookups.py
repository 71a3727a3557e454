"""Lookup tables and rule lists for device, browser and mail texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rowwise import decision_list, recode
from .safe import c

# Operating system release dates.
OS_RELEASES = {
    "android": {
        "4.4.2": "2013-12-09", "5.0": "2014-11-12", "5.0.2": "2014-12-19", "5.1.1": "2015-03-09",
        "6.0": "2015-10-05", "6.0.1": "2015-12-07", "7.0": "2016-08-22", "7.1.1": "2016-12-05",
        "7.1.2": "2017-04-04", "8.0.0": "2017-08-21", "8.1.0": "2017-12-05", "9": "2018-08-06",
    },
    "ios": {
        "9.3.5": "2016-08-25", "10.0.2": "2016-09-23", "10.1.1": "2016-10-31", "10.2.0": "2016-12-12",
        "10.2.1": "2017-01-23", "10.3.1": "2017-04-03", "10.3.2": "2017-05-15", "10.3.3": "2017-07-19",
        "11.0.0": "2017-09-19", "11.0.1": "2017-09-26", "11.0.2": "2017-10-03", "11.0.3": "2017-10-11",
        "11.1.0": "2017-10-31", "11.1.1": "2017-11-09", "11.1.2": "2017-11-16", "11.2.0": "2017-12-02",
        "11.2.1": "2017-12-13", "11.2.2": "2018-01-08", "11.2.5": "2018-01-23", "11.2.6": "2018-02-19",
        "11.3.0": "2018-03-29", "11.3.1": "2018-04-24", "11.4.0": "2018-05-29", "11.4.1": "2018-07-09",
        "12.0.0": "2018-09-16", "12.0.1": "2018-10-09", "12.1.0": "2018-11-05", "12.1.1": "2018-12-05",
        "12.1.2": "2018-12-16",
    },
    "mac": {
        "10.6": "2010-08-28", "10.6.8": "2011-06-23", "10.7.5": "2012-09-19", "10.8.5": "2013-09-12",
        "10.9": "2013-10-22", "10.9.5": "2014-09-17", "10.10": "2014-10-16", "10.10.5": "2015-08-13",
        "10.11": "2015-09-30", "10.11.3": "2016-01-19", "10.11.4": "2016-03-20", "10.11.5": "2016-03-20",
        "10.11.6": "2016-07-18", "10.12": "2016-09-20", "10.12.1": "2016-10-24", "10.12.2": "2016-12-13",
        "10.12.3": "2017-01-23", "10.12.4": "2017-03-27", "10.12.5": "2017-05-15", "10.12.6": "2017-07-19",
        "10.13": "2017-09-25", "10.13.1": "2017-10-31", "10.13.2": "2017-12-06", "10.13.3": "2018-01-23",
        "10.13.4": "2018-03-29", "10.13.5": "2018-06-01", "10.13.6": "2018-07-09", "10.14": "2018-09-01",
        "10.14.0": "2018-09-01", "10.14.1": "2018-10-30", "10.14.2": "2019-12-05", "10.14.3": "2019-01-22",
    },
    "windows": {
        "xp": "2001-10-25", "vista": "2007-01-30", "7": "2009-10-22", "8": "2012-10-26",
        "8.1": "2013-10-18", "10": "2015-07-29",
    },
}

# Mail provider by domain.
MAIL_PROVIDERS = {
    "gmail": "google", "att.net": "att", "twc.com": "spectrum", "scranton.edu": "other", "optonline.net": "other",
    "hotmail.co.uk": "microsoft", "comcast.net": "other", "yahoo.com.mx": "yahoo", "yahoo.fr": "yahoo",
    "yahoo.es": "yahoo", "charter.net": "spectrum", "live.com": "microsoft", "aim.com": "aol",
    "hotmail.de": "microsoft", "centurylink.net": "centurylink", "gmail.com": "google", "me.com": "apple",
    "earthlink.net": "other", "gmx.de": "other", "web.de": "other", "cfl.rr.com": "other",
    "hotmail.com": "microsoft", "protonmail.com": "other", "hotmail.fr": "microsoft", "windstream.net": "other",
    "outlook.es": "microsoft", "yahoo.co.jp": "yahoo", "yahoo.de": "yahoo", "servicios-ta.com": "other",
    "netzero.net": "other", "suddenlink.net": "other", "roadrunner.com": "other", "sc.rr.com": "other",
    "live.fr": "microsoft", "verizon.net": "yahoo", "msn.com": "microsoft", "q.com": "centurylink",
    "prodigy.net.mx": "att", "frontier.com": "yahoo", "anonymous.com": "anonymous", "rocketmail.com": "yahoo",
    "sbcglobal.net": "att", "frontiernet.net": "yahoo", "ymail.com": "yahoo", "outlook.com": "microsoft",
    "mail.com": "anonymous", "bellsouth.net": "other", "embarqmail.com": "centurylink", "cableone.net": "other",
    "hotmail.es": "microsoft", "mac.com": "apple", "yahoo.co.uk": "yahoo", "netzero.com": "other",
    "yahoo.com": "yahoo", "live.com.mx": "microsoft", "ptd.net": "other", "cox.net": "other", "aol.com": "aol",
    "juno.com": "other", "icloud.com": "apple",
}

# Device country by text found in the device, then in the browser.
_COUNTRY_BY_DEVICE = [
    ("Korea", "sm"), ("Korea", "samsung"), ("Korea", "gt-"), ("Korea", "lg"), ("China", "moto"), ("RV", "rv"),
    ("China", "hi"), ("China", "redmi"), ("China", "huawei"), ("China", "ale-"), ("China", "-l"),
    ("China", "blade"), ("China", "zte"), ("China", "tride"), ("US", "linux"), ("Japan", "xt"), ("China", "htc"),
    ("China", "asus"), ("Build", "build"), ("US", "window"), ("US", "ios"), ("US", "mac"), ("US", "nexus"),
    ("China", "lenovo"), ("US", "pixel"),
]
_COUNTRY_BY_BROWSER = [("Korea", "samsun"), ("US", "google"), ("Korea", "line")]

# Operating system by text found in the device name or the browser.
_OS_BY_DEVICE = [
    ("windows", "window"), ("mac", "mac"), ("ios", "ios"), ("android", "samsun"), ("windows", "trid"),
    ("android", "moto"), ("android", "huaw"), ("android", "lg"), ("android", "sony"), ("android", "htc"),
    ("android", "zte"), ("linux", "linux"),
]
_BROWSER_NAMES = [
    ("generic", "generic"), ("safari", "mobile"), ("safari", "safari"), ("chrome", "chrome"),
    ("firefox", "firefox"), ("ie", "edge"), ("ie", "ie"), ("ie", "window"), ("android", "android"),
    ("desktop", "desktop"), ("ios", "ios"), ("samusung", "samsun"), ("google", "google"), ("opera", "opera"),
]
_BROWSER_OS_FIRST = [("ios", "mobile"), ("mac", "safari"), ("ios", "ios"), ("android", "android")]
_BROWSER_OS_LAST = [
    ("windows", "chrome"), ("windows", "firefox"), ("windows", "edge"), ("windows", "ie"), ("windows", "window"),
    ("windows", "desktop"), ("windows", "opera"), ("android", "samsun"), ("android", "google"),
    ("android", "line"),
]

# Device names, later rules win.
DEVICE_NAMES = [
    ("samsung", "sm"), ("samsung", "samsung"), ("samsung", "gt-"), ("motorola", "moto"), ("lg", "lg-"),
    ("rv", "rv:"), ("huawei", "huawei"), ("zte", "blade"), ("linux", "linux"), ("sony", "xt"), ("htc", "htc"),
    ("asus", "asus"), ("huawei", "hi"), ("huawei", "ale-"), ("huawei", "-l"), ("ios", "ios"),
    ("android", "android"),
]


def country_rules(device: str, browser: str) -> list[tuple]:
    return [(lab, (device, t)) for lab, t in _COUNTRY_BY_DEVICE] + [
        (lab, (browser, t)) for lab, t in _COUNTRY_BY_BROWSER
    ]


def device_os_rules(name: str, browser: str, os: str) -> list[tuple]:
    """Device first, then the stated system, then the browser for unknown and other devices."""
    rules = [(lab, (name, t)) for lab, t in _OS_BY_DEVICE]
    rules += [("android", (name, "rv"), (browser, "mobile")), ("windows", (name, "rv"))]
    native = [("ios", "ios"), ("android", "android"), ("android", "google"), ("android", "sam"), ("android", "line")]
    guess = [
        ("ios", "mobile"), ("mac", "safari"), ("windows", "chrome"), ("windows", "chr"), ("windows", "opera"),
        ("windows", "ie"), ("windows", "edge"), ("windows", "desktop"), ("windows", "fire"),
    ]
    rules += [(lab, (name, "#"), (browser, t)) for lab, t in native]
    rules += [(x, (os, x)) for x in ("android", "ios", "windows", "mac")]
    rules += [(lab, (name, "#"), (browser, t)) for lab, t in guess]
    rules += [(lab, (name, "ther"), (browser, t)) for lab, t in native + guess]
    return rules


def browser_name_rules(browser: str) -> list[tuple]:
    return [(lab, (browser, t)) for lab, t in _BROWSER_NAMES]


def browser_os_rules(name: str, browser: str) -> list[tuple]:
    rules = [("android", (browser, "mobile"), (browser, "fire"))]
    rules += [(lab, (browser, t)) for lab, t in _BROWSER_OS_FIRST]
    rules += [(lab, (name, t)) for lab, t in _OS_BY_DEVICE] + [("windows", (name, "rv"))]
    return rules + [(lab, (browser, t)) for lab, t in _BROWSER_OS_LAST]


def device_country(device: str, browser: str) -> Column:
    return decision_list(country_rules(device, browser), "Unk")


def device_os(name: str, browser: str, os: str) -> Column:
    return decision_list(device_os_rules(name, browser, os), "other_device_os")


def browser_name(browser: str) -> Column:
    return decision_list(browser_name_rules(browser), "other_browser_name")


def browser_os(name: str, browser: str) -> Column:
    return decision_list(browser_os_rules(name, browser), "other_browser_os")


def device_name(value: str | Column) -> Column:
    """Maker from the device text. A rule sees the result of the rules before it."""
    rules = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("token")) for n, t in DEVICE_NAMES])
    return F.aggregate(rules, c(value), lambda v, r: F.when(v.contains(r["token"]), r["name"]).otherwise(v))


def mail_provider(domain: str | Column) -> Column:
    return recode(domain, MAIL_PROVIDERS)


# -- release dates ------------------------------------------------------------


def normal_os_text(value: str | Column) -> Column:
    """Lower case, dots for underscores, and a single-word name for the desktop system."""
    t = F.replace(F.lower(F.coalesce(c(value), F.lit("#"))), F.lit("_"), F.lit("."))
    return F.replace(t, F.lit("mac os x"), F.lit("mac"))


def _pieces(v: Column, *spans: tuple[int, int]) -> Column:
    return F.concat_ws(".", *[F.substring(v, a, n) for a, n in spans])


def version_candidates(os: Column, ver: Column) -> list[Column]:
    """Version spellings to look up, in order. Dotless versions are cut by length."""
    n = F.length(ver)
    first2 = os.contains("mac") | os.contains("ios")
    cand = [ver]
    cand.append(F.when(first2 & (n == 5), _pieces(ver, (1, 2), (3, 2), (5, 1))))
    cand.append(F.when(os.contains("mac") & (n == 4), _pieces(ver, (1, 2), (3, 2))))
    cand.append(F.when(first2 & (n == 4), _pieces(ver, (1, 2), (3, 1), (4, 1))))
    cand.append(F.when(os.contains("mac") & (n == 3), _pieces(ver, (1, 2), (3, 1))))
    cand.append(F.when((os.contains("ios") | os.contains("andro")) & (n == 3), _pieces(ver, (1, 1), (2, 1), (3, 1))))
    win = F.when(ver.contains("x"), "xp").when(ver.contains("v"), "vista").when(ver.contains("7"), "7")
    win = win.when(ver.contains("8"), "8").when(ver.contains("10"), "10")
    cand.append(F.when(os.contains("window"), win))
    return cand


def os_release_date(os: str | Column, version: str | Column) -> Column:
    """Release date of (system, version) from a literal table, over the spellings in order."""
    table = F.create_map(*[F.lit(x) for o, vs in OS_RELEASES.items() for v, d in vs.items() for x in (f"{o}|{v}", d)])
    o, v = c(os), F.replace(F.replace(c(version), F.lit("_"), F.lit(".")), F.lit(" "), F.lit(""))
    hits = [F.try_element_at(table, F.concat(o, F.lit("|"), x)) for x in version_candidates(o, v)]
    return F.coalesce(*hits).cast("date")


def os_match(device_os: str | Column, browser_os: str | Column, browser: str | Column) -> Column:
    """1 where device and browser agree on the system; Chrome on a Mac counts as agreement."""
    return ((c(device_os) == c(browser_os)) | ((c(device_os) == "mac") & (c(browser) == "chrome"))).cast("int")
