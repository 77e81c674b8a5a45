"""Command line: ``python -m folioflow``."""

from __future__ import annotations

import argparse
import os
import sys
from functools import partial

from folioflow.config import Profile, Settings, list_profiles, read_env
from folioflow.operators.http_provider import HttpProvider
from folioflow.plans.pipeline import Job, Pipeline, uri
from folioflow.prompts import patient_context
from folioflow.sinks.logs import set_up


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="folioflow", description="Process scanned documents into page records and summaries.")
    # The names of the options.
    p.add_argument("--profile", "-p", help="profile to run; all profiles without it")
    p.add_argument("--profiles-dir", default="profiles")
    p.add_argument("--list-profiles", action="store_true")
    p.add_argument("--regenerate", action="store_true", help="summaries of all documents again, and a check of frontmatter")
    p.add_argument("--resummarize", action="store_true", help="summaries again, of one document with -d")
    p.add_argument("--reprocess-all", action="store_true")
    p.add_argument("--document", "-d")
    p.add_argument("--page", type=int)
    p.add_argument("--model", "-m")
    p.add_argument("--workers", "-w", type=int)
    p.add_argument("--pattern")
    p.add_argument("--env")
    p.add_argument("--dry-run", action="store_true")
    return p


def run_profile(spark, profile: Profile, args: argparse.Namespace, env: dict[str, str], provider) -> bool:
    """One profile; false if it could not run."""
    if not profile.input_path or not profile.output_path:
        print(f"profile {profile.name} has no input_path or no output_path", file=sys.stderr)
        return False
    settings = Settings.from_env(env).overridden(profile, args.model, args.workers, args.dry_run)
    if provider is None:
        provider = partial(HttpProvider, settings)
    pattern = args.pattern or profile.input_file_regex or env.get("INPUT_FILE_REGEX") or r".*\.pdf"
    job = Job(
        profile.input_path, profile.output_path, provider, pattern=pattern, n_extractions=settings.n_extractions, max_input_tokens=settings.max_input_tokens,
        birth_date=profile.birth_date, context=patient_context(profile.full_name, profile.birth_date, profile.locale), workers=settings.max_workers,
    )
    pipeline = Pipeline(spark, job)
    log = set_up(None if settings.dry_run else uri(f"{job.output_path}/logs"), clear=True)
    if settings.dry_run:
        for row in pipeline.dry_run(reprocess_all=args.reprocess_all, document=args.document).toLocalIterator():
            log.info("%s: %s pages", row["doc_stem"], row["pages"])
        return True
    if args.regenerate or args.resummarize:
        done = pipeline.regenerate(args.document if args.resummarize else None)
        log.info("%s documents summarised", done.count())
        if args.regenerate:
            for row in pipeline.frontmatter_issues().toLocalIterator():
                log.error("%s: %s %s", row["file_name"], row["issue"], list(row["missing"]))
            for row in pipeline.odd_categories().toLocalIterator():
                log.warning("%s: category %s", row["file_name"], row["category"])
        return True
    report = pipeline.process(args.reprocess_all, args.document, args.page)
    for row in report.status.toLocalIterator():
        log.info("%s: %s documents, %s pages", row["status"], row["documents"], row["pages"])
    for row in report.issues.toLocalIterator():
        log.error("%s: %s %s", row["doc_stem"], row["issue"], row["detail"])
    return True


def main(argv: list[str] | None = None, provider=None, spark=None) -> int:
    args = parser().parse_args(argv)
    names = list_profiles(args.profiles_dir)
    if args.list_profiles:
        print("\n".join(names) or "no profiles")
        return 0
    if args.page is not None and not args.document:
        print("--page needs --document", file=sys.stderr)
        return 2
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("folioflow").getOrCreate()
    env = dict(os.environ) | read_env(".", args.env)
    ok = [run_profile(spark, Profile.find(args.profiles_dir, n), args, env, provider) for n in ([args.profile] if args.profile else names)]
    return 0 if ok and all(ok) else 1


if __name__ == "__main__":
    sys.exit(main())
