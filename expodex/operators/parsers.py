"""Reviewed parsers of single sites, each run in a process of its own with limits of time and memory.

Pages meet their domain's parser in a table function that is partitioned by domain; domains with many pages are
dealt to several parts. A part starts one child process, which holds the parser and nothing of Spark; a page that takes too
long, too much memory, or ends the child, gives an error and a new child for the next page.

Defined results: pages without a parser for their domain give no rows; a parser that raises, hangs, dies or returns
anything but a list of at most MOST_ROWS dictionaries, of whose first TESTED one has a name, gives one row with `error`;
dictionaries without a name are left out; a null html is an empty one; repeated pages are parsed as often as they
occur; empty tables give empty results.
"""

from __future__ import annotations

import os
import pickle
import select
import struct
import subprocess
import sys
import time
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import urls as U

Parser = Callable[[str], list[dict]]

#: Seconds a page may take, rows a page may give, and among how many a name is looked for.
SECONDS, MOST_ROWS, TESTED = 30.0, 10_000, 20
# End of fixed values.
MEMORY = 1 << 30
#: Pages of one domain that a child process sees, about.
PAGES = 5000
PARSED = "page_id long, url string, domain string, ord int, name string, extras map<string,string>, error string"

_CHILD = """
import os, pickle, resource, struct, sys
answer = os.dup(1)
os.dup2(2, 1)
source = os.fdopen(0, "rb")
def read():
    head = source.read(8)
    if len(head) < 8:
        os._exit(0)
    return source.read(struct.unpack("<q", head)[0])
sys.path[:], memory = pickle.loads(read())
if memory:
    resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
parse = pickle.loads(read())
while True:
    html = read().decode("utf-8", "surrogatepass")
    try:
        out = (parse(html), None)
        body = pickle.dumps(out)
    except BaseException as e:
        body = pickle.dumps((None, f"{type(e).__name__}: {e}"[:300]))
    body = struct.pack("<q", len(body)) + body
    while body:
        body = body[os.write(answer, body):]
"""


class Child:
    """A process that holds one parser."""

    def __init__(self, parser: Parser, memory: int = MEMORY):
        self.p = subprocess.Popen([sys.executable, "-c", _CHILD], stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, close_fds=True, start_new_session=True)
        for part in (pickle.dumps((sys.path, memory)), cloudpickle.dumps(parser)):
            self._send(part)

    def _send(self, body: bytes) -> None:
        self.p.stdin.write(struct.pack("<q", len(body)) + body)
        self.p.stdin.flush()

    def _read(self, n: int, until: float) -> bytes:
        out, fd = bytearray(), self.p.stdout.fileno()
        while len(out) < n:
            left = until - time.monotonic()
            if left <= 0 or not select.select([fd], [], [], left)[0]:
                raise TimeoutError("the parser took too long")
            block = os.read(fd, min(1 << 16, n - len(out)))
            if not block:
                raise EOFError("the parser ended its process")
            out += block
        return bytes(out)

    def ask(self, html: str, seconds: float) -> tuple[object, str | None]:
        """(what the parser returned, error)."""
        until = time.monotonic() + seconds
        self._send(html.encode("utf-8", "surrogatepass"))
        return pickle.loads(self._read(struct.unpack("<q", self._read(8, until))[0], until))

    def end(self) -> None:
        self.p.kill()
        self.p.wait()
        self.p.stdin.close()
        self.p.stdout.close()


def judged(rows: object) -> tuple[list[tuple[str, dict[str, str]]], str | None]:
    """((name, other fields) of each row, error) of what a parser returned."""
    if not isinstance(rows, list):
        return [], f"a list was expected, not {type(rows).__name__}"
    if not 1 <= len(rows) <= MOST_ROWS:
        return [], f"{len(rows)} rows"
    if not any(isinstance(r, dict) and r.get("name") for r in rows[:TESTED]):
        return [], f"no name in the first {TESTED} rows"
    return [(str(r["name"]), {str(a): str(b) for a, b in r.items() if b and a != "name"}) for r in rows if isinstance(r, dict) and r.get("name")], None


def _function(parsers: dict[str, Parser], seconds: float, memory: int):
    class ParsePages:
        """Rows of a part of one domain's pages, in the order of page_id."""

        def __init__(self) -> None:
            self.child: Child | None = None

        def eval(self, row: Row) -> Iterator[tuple]:
            own = (row["page_id"], row["url"], row["domain"])
            if self.child is None:
                self.child = Child(parsers[row["domain"]], memory)
            try:
                found, error = self.child.ask(row["html"] or "", seconds)
            except (TimeoutError, EOFError, OSError, pickle.UnpicklingError) as e:
                self._end()
                found, error = None, str(e) or type(e).__name__
            rows, error = ([], error) if error is not None else judged(found)
            if error is not None:
                yield (*own, None, None, None, error)
            for k, (name, extras) in enumerate(rows):
                yield (*own, k, name, extras, None)

        def _end(self) -> None:
            if self.child is not None:
                self.child.end()
                self.child = None

        def terminate(self) -> Iterator[tuple]:
            self._end()
            return iter(())

    return F.udtf(ParsePages, returnType=PARSED)


def parsed(pages: DataFrame, parsers: dict[str, Parser], seconds: float = SECONDS, memory: int = MEMORY) -> DataFrame:
    """(page_id, url, html) -> PARSED: rows of each page by the parser of its host (without www.), or its error."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", U.bare_host(F.col("url")).alias("domain")).filter(F.col("domain").isin(sorted(parsers)))
    # One row a parser, so a small table whatever the pages.
    parts = rows.groupBy("domain").agg(F.ceil(F.count("*") / F.lit(float(PAGES))).cast("int").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "domain").withColumn("part", F.pmod(F.xxhash64("page_id", "url"), F.col("parts")).cast("int")).drop("parts")
    return _function(parsers, seconds, memory)(dealt.asTable().partitionBy("domain", "part").orderBy("page_id"))


def outcomes(rows: DataFrame) -> DataFrame:
    """domain, pages, failed, rows, last_error of parsed() rows."""
    return rows.groupBy("domain").agg(F.count_distinct("page_id", "url").alias("pages"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("error").isNull()).alias("rows"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("page_id"))).alias("last_error"))
