"""python -m rastrel SRC DST: converts a folder of pictures and prints the counters."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .functions import vp8
from .operators import convert, outcomes
from .session import session
from .sources import files


def main() -> None:
    p = argparse.ArgumentParser(prog="rastrel")
    p.add_argument("src")
    p.add_argument("dst")
    p.add_argument("--quality", type=float, default=90)
    p.add_argument("--no-recursive", action="store_true")
    p.add_argument("--no-verify", action="store_true")
    p.add_argument("--min-psnr", type=float, default=convert.MIN_PSNR)
    p.add_argument("--skip-existing", action="store_true")
    p.add_argument("--tables", help="the text of RFC 6386, from which the probabilities of the format are read; without it other decoders can't read the outputs")
    p.add_argument("--keep-failed", metavar="FOLDER", help="where files that can't be converted are copied")
    a = p.parse_args()
    spark = session()
    files.register(spark)
    src = a.src if ":" in a.src else f"file:{a.src}"
    found = files.listing(spark, src, not a.no_recursive).select(files.relative(F.col("path"), src).alias("rel"), "content")
    have = None
    if a.skip_existing:
        old = spark.read.format("imagecorpus").option("path", a.dst).option("headerBytes", 1).load()
        have = old.select(files.relative(F.col("path"), a.dst).alias("out_path"))
    tables = vp8.Tables.load(a.tables) if a.tables else None
    done = convert.convert(found, have, quality=a.quality, min_psnr=None if a.no_verify else a.min_psnr, tables=tables).persist()
    convert.write(done, a.dst)
    if a.keep_failed:
        convert.quarantine(done, found, a.keep_failed)
    outcomes.rollup(done).show(truncate=False)
    done.where("status = 'fail'").select("rel", "note").orderBy("rel").limit(50).show(50, truncate=False)


if __name__ == "__main__":
    main()
