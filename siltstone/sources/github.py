"""Repositories: what an address says, a shallow checkout, its files, and the version at the other end."""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
import tempfile
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.scratch import shared_dir

from . import local
from .http import Fetch

#: Where repositories and their versions are asked for; fixed values, which tests point elsewhere.
ROOT, API = "https://github.com", "https://api.github.com"
BRANCHES, DOCS = ("main", "master"), "docs"


def parsed(url: Column) -> dict[str, Column]:
    """repo (owner/name), branch and docs_path of an address; docs_path is docs where it names none."""
    parts = F.split(F.regexp_replace(url, r"^https?://(?:www\.)?github\.com/|\.git$|/+$", ""), "/")
    tree = F.get(parts, F.lit(2)) == "tree"
    deep = F.array_join(F.slice(parts, 5, F.greatest(F.size(parts) - 4, F.lit(0))), "/")
    return {
        "repo": F.when(F.size(parts) >= 2, F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))),
        "branch": F.when(tree, F.get(parts, F.lit(3))),
        "docs_path": F.when(tree & (deep != ""), deep).otherwise(F.lit(DOCS)),
    }


def located(source: dict[str, Any]) -> dict[str, Any] | None:
    """A source's entry with repo, branch and docs_path, from its own fields or its address; None if it names no repository."""
    said = re.match(r"https?://(?:www\.)?github\.com/([^/]+/[^/]+?)(?:\.git)?(?:/tree/([^/]+)(?:/(.+?))?)?/*$", source.get("url") or "")
    repo = source.get("repo") or (said[1] if said else "")
    if not repo:
        return None
    return source | {"repo": repo, "branch": said[2] if said and said[2] else "", "docs_path": source.get("docs_path") or (said[3] if said and said[3] else DOCS)}


def _git(*args: str) -> subprocess.CompletedProcess[str]:
    return subprocess.run(["git", *args], capture_output=True, text=True, env=os.environ | {"GIT_TERMINAL_PROMPT": "0"})


def checkout(repo: str, docs_path: str, into: str, branch: str = "", root: str | None = None) -> str:
    """A sparse checkout of depth one into an empty folder of this machine; the commit's first 12 digits."""
    for name in [branch] if branch else BRANCHES:
        shutil.rmtree(into, ignore_errors=True)
        done = _git("clone", "--depth", "1", "--filter=blob:none", "--sparse", "--branch", name, f"{root or ROOT}/{repo}", into)
        if done.returncode == 0:
            break
    else:
        raise OSError(f"no branch of {repo} could be cloned: {done.stderr[-300:]}")
    for args in (("sparse-checkout", "set", docs_path), ("rev-parse", "HEAD")):
        done = _git("-C", into, *args)
        if done.returncode:
            raise OSError(f"{repo}: {done.stderr[-300:]}")
    return done.stdout[:12]


def read(spark: SparkSession, source: dict[str, Any]) -> tuple[DataFrame, str]:
    """Raw documents below the docs path, and the version.

    The driver checks out into a folder of its own, each time a new one, and copies the docs path to the folder that it
    shares with the executors, which read the files; only the last part of the glob counts, on file names."""
    found = located(source)
    if found is None:
        raise ValueError(f"{source['name']}: no repository is named")
    with tempfile.TemporaryDirectory() as own:
        version = checkout(found["repo"], found["docs_path"], f"{own}/tree", found["branch"])
        below = found["docs_path"].strip("/")
        if not os.path.isdir(f"{own}/tree/{below}"):
            raise FileNotFoundError(f"{found['repo']} has no folder {below}")
        target = f"{shared_dir(spark)}/checkout-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(path(f"{target}/{below}").getParent())
        fs.copyFromLocalFile(path(f"{own}/tree/{below}"), path(f"{target}/{below}"))
    return local.read(spark, source["name"], target, (found.get("glob") or "*.md").rsplit("/", 1)[-1]), version


def remote_version(body: str, status: int) -> str | None:
    """The commit of an answer about a branch's head; None if there is none or the limit of calls is reached (403)."""
    if status != 200:
        return None
    try:
        sha = json.loads(body).get("sha")
    except (ValueError, AttributeError):
        return None
    return sha[:12] if isinstance(sha, str) and re.fullmatch("[0-9a-f]{40}", sha) else None


def check_version(source: dict[str, Any], fetch: Fetch) -> str | None:
    """The version at the other end, of the named branch or the first usual one that is there."""
    found = located(source)
    for branch in ([found["branch"]] if found["branch"] else BRANCHES) if found else ():
        got = fetch(f"{API}/repos/{found['repo']}/commits/{branch}")
        if got is None or got[0] == 403:  # silent, or the limit of calls
            return None
        if version := remote_version(got[2], got[0]):
            return version
    return None
