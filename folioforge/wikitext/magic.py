"""Magic words: values of a run and of a page."""

from __future__ import annotations

import re
from datetime import datetime
from urllib.parse import quote

# English month and day names, used for every language.
MONTHS = "January February March April May June July August September October November December".split()
DAYS = "Sunday Monday Tuesday Wednesday Thursday Friday Saturday".split()


def clock_words(now: datetime) -> dict[str, str]:
    """CURRENT* and their LOCAL* twins at an explicit time."""
    month, dow = MONTHS[now.month - 1], (now.weekday() + 1) % 7
    words = {
        "YEAR": f"{now.year}",
        "MONTH": f"{now.month:02d}",
        "MONTH1": f"{now.month}",
        "MONTH2": f"{now.month:02d}",
        "MONTHNAME": month,
        "MONTHNAMEGEN": month,
        "MONTHABBREV": month[:3],
        "DAY": f"{now.day}",
        "DAY2": f"{now.day:02d}",
        "DOW": f"{dow}",
        "DAYNAME": DAYS[dow],
        "TIME": f"{now:%H:%M}",
        "HOUR": f"{now:%H}",
        "WEEK": f"{now.isocalendar().week}",
        "TIMESTAMP": f"{now:%Y%m%d%H%M%S}",
    }
    return {p + k: v for k, v in words.items() for p in ("CURRENT", "LOCAL")}


def site_words(sitename: str = "Wikipedia", urlbase: str = "https://en.wikipedia.org/wiki", language: str = "en") -> dict[str, str]:
    server = re.sub(r"^((?:https?:)?//[^/]+).*$", r"\1", urlbase)
    return {"SITENAME": sitename, "SERVER": server, "SERVERNAME": re.sub(r"^(?:https?:)?//", "", server), "CONTENTLANGUAGE": language, "CONTENTLANG": language, "CURRENTVERSION": "1.45.0", "!": "|", "=": "="}


def page_words(title: str, namespace: str = "", number: int = 0) -> dict[str, str]:
    full = f"{namespace}:{title}" if namespace else title
    enc = lambda s: quote(s, safe="-_.!~*'()")
    return {
        "PAGENAME": title,
        "PAGENAMEE": enc(title),
        "FULLPAGENAME": full,
        "FULLPAGENAMEE": enc(full),
        "NAMESPACE": namespace,
        "NAMESPACEE": enc(namespace),
        "NAMESPACENUMBER": str(number),
        "BASEPAGENAME": title.rsplit("/", 1)[0],
        "SUBPAGENAME": title.rsplit("/", 1)[1] if "/" in title else "",
        "ROOTPAGENAME": title.split("/", 1)[0],
        "TALKPAGENAME": "",
        "SUBJECTPAGENAME": title,
        "ARTICLEPAGENAME": title,
        "PAGEID": "0",
    }
