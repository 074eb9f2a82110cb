"""python -m palimpsest STORE COMMAND ...: a store from the command line. Keys and values are text."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .sources.store import Store


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, *fields in (("put", "key", "value"), ("delete", "key"), ("get", "key"), ("history", "key"), ("scan",), ("stats",), ("flush",), ("compact",), ("gc",)):
        one = commands.add_parser(name)
        for f in fields:
            one.add_argument(f)
        if name == "scan":
            one.add_argument("--low")
            one.add_argument("--high")
    given = parser.parse_args(arguments)
    store = Store.open(SparkSession.builder.appName("palimpsest").getOrCreate(), given.store)
    shown = lambda b: None if b is None else bytes(b).decode("utf-8", "replace")
    if given.command == "put":
        print(store.put(given.key, given.value))
    elif given.command == "delete":
        print(store.delete(given.key))
    elif given.command == "get":
        value = store.get(given.key)
        if value is None:
            return 1
        print(shown(value))
    elif given.command == "history":
        for r in store.get_all(given.key).toLocalIterator():
            print(json.dumps([r.seq, shown(r.value)]))
    elif given.command == "scan":
        for r in store.range_live(given.low, given.high).orderBy("key").toLocalIterator():
            print(json.dumps([shown(r.key), shown(r.value)]))
    elif given.command == "stats":
        print(json.dumps(store.stats()))
    else:
        {"flush": store.flush, "compact": store.compact, "gc": store.collect_garbage}[given.command]()
    return 0


if __name__ == "__main__":
    sys.exit(main())
