"""Print the formatted physical plan of registered queries after running them
(so AQE's final plan is shown).

usage: python tools/show_plans.py [sf_dir] key [key ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf_dir = args.pop(0)
    from murmur.plans.catalog import QUERIES
    from murmur.session import local_session

    spark = local_session(8)
    for key in args:
        df = QUERIES[key](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        print("=" * 20, key)
        df.explain("formatted")


if __name__ == "__main__":
    main()
