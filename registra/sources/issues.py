"""Issues kept as folders of files on a branch: a folder is an issue, its files are attributes, its dependencies edges."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import Register, literal

_ID = "[0-9a-f]{32}"
BRANCH = "entomologist-data"


def materialise(repository: str, revision: str, to: str, timeout: float = 60) -> str:
    """The files of a revision under a folder, by the driver's git, for timeout seconds at most."""
    os.makedirs(to, exist_ok=True)
    with subprocess.Popen(["git", "-C", repository, "archive", revision], stdout=subprocess.PIPE, stderr=subprocess.PIPE) as git:  # noqa: S603, S607
        try:
            subprocess.run(["tar", "-x", "-C", to], stdin=git.stdout, check=True, timeout=timeout, capture_output=True)  # noqa: S603, S607
            if git.wait(timeout):
                raise ValueError(f"git archive {revision}: {git.stderr.read().decode('utf-8', 'replace').strip()}")
        except (subprocess.SubprocessError, OSError) as e:
            git.kill()
            raise ValueError(f"revision {revision}: {e}") from e
    return to


def read_issues(files: DataFrame, branch: str = BRANCH) -> Register:
    r"""files: file, content -> issues. <id>/description gives the summary (its first line), author, assignee and state their texts, tags/<name> a tag, dependencies/<id> an edge.

    In a tag's name ,0 is a comma and ,1 a slash; any other file, or a tag with another escape, is a PARSE_ERROR. The state is new where its file is absent."""
    f = files.select("file", F.decode("content", "utf-8").alias("text"), F.regexp_extract("file", rf"^({_ID})/", 1).alias("id"), F.regexp_extract("file", rf"^{_ID}/(.+)$", 1).alias("rest")).filter("id <> ''")
    place = F.concat(F.lit(f"{branch}:"), F.col("file"))
    tag = F.regexp_extract("rest", r"^tags/(.+)$", 1)
    wrong_tag = F.col("rest").startswith("tags/") & tag.rlike(",(?![01])")
    plain = F.regexp_replace(F.regexp_replace(tag, ",1", "/"), ",0", ",")
    known = F.col("rest").isin("description", "author", "assignee", "state", "creation_time", "done_time") | F.col("rest").rlike(rf"^(tags/[^/]+|dependencies/{_ID}|comments/.+)$")
    first = lambda name: F.max(F.when(F.col("rest") == name, F.trim(F.split("text", "\n")[0])))
    tags = F.array_sort(F.collect_set(F.when(F.col("rest").startswith("tags/") & ~wrong_tag, plain)))
    g = f.groupBy("id").agg(first("description").alias("summary"), first("author").alias("author"), first("assignee").alias("assignee"), F.coalesce(first("state"), F.lit("new")).alias("state"), tags.alias("tags"))
    values = F.map_from_entries(F.filter(F.array(*(F.struct(F.lit(a).alias("key"), (F.to_json("tags") if a == "tags" else literal(F.col(a), "string")).alias("value")) for a in ("summary", "author", "assignee", "state", "tags"))), lambda x: x.value.isNotNull()))
    order = F.row_number().over(Window.partitionBy(F.substring("id", 1, 2)).orderBy("id")) + F.conv(F.substring("id", 1, 2), 16, 10).cast("long") * F.lit(1 << 40)
    nodes = g.select("id", F.lit("issue").alias("kind"), values.alias("attrs"), F.concat(F.lit(f"{branch}:"), "id").alias("file"), F.lit(0).cast("long").alias("line"), order.alias("ord"))
    on = F.regexp_extract("rest", rf"^dependencies/({_ID})$", 1)
    edges = f.withColumn("on", on).filter("on <> ''").select(F.col("id").alias("src"), F.col("on").alias("tgt"), F.lit("depends_on").alias("kind"), F.create_map().cast("map<string,string>").alias("attrs"), place.alias("file"), F.lit(0).cast("long").alias("line"), F.lit(0).cast("long").alias("ord"))
    why = F.when(wrong_tag, "bad escape in a tag's name").otherwise("unknown file")
    bad = f.filter(~known | wrong_tag).select(F.lit("error").alias("severity"), F.lit("PARSE_ERROR").alias("code"), F.concat(place, F.lit(": "), why).alias("message"), F.col("id").alias("node_id"), place.alias("file"), F.lit(0).cast("long").alias("line"))
    return Register(nodes, edges, {}, bad)


def read_branch(spark: SparkSession, repository: str, to: str, branch: str = BRANCH) -> Register:
    """Issues of a repository's branch, extracted by the driver to a folder that executors share."""
    from .files import read_folder

    return read_issues(read_folder(spark, materialise(repository, branch, to), ["**"]), branch)
