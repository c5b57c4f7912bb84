"""Command line: python -m loamstack ROOT SCOPE (init | validate | bootstrap TREE | ingest FILE | retrieve TEXT | operation ID | lint)."""

from __future__ import annotations

import json
import sys


def main(args: list[str]) -> int:
    if len(args) < 3:
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    from loamstack.engine import Engine
    from loamstack.operators import evidence
    from loamstack.sources import bootstrap, workspace

    root, scope, command, *rest = args
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if command == "init":
        print(json.dumps(workspace.init(spark, root)))
        return 0
    if command == "validate":
        lacking = workspace.missing(spark, root)
        print(json.dumps(lacking))
        return int(bool(lacking))
    if command == "bootstrap":  # before the engine writes anything
        bootstrap.require_disjoint(spark, rest[0], root)
    engine = Engine(spark, root, scope)
    if command == "bootstrap":
        print(json.dumps(engine.bootstrap(bootstrap.tree(spark, rest[0]))))
    elif command == "ingest":
        with open(rest[0], "rb") as f:
            content = f.read()
        import hashlib

        print(engine.ingest("file", rest[0], f"sha256-{hashlib.sha256(content).hexdigest()[:16]}", content))
    elif command == "retrieve":
        print(evidence.encoded(engine.retrieve(" ".join(rest))).first()[0])
    elif command == "operation":
        print(json.dumps(engine.operation(rest[0])))
    elif command == "lint":
        for row in engine.lint().collect():
            print(json.dumps(row.asDict()))
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
