"""Small source files beside the code table: it holds no classes, interfaces or nested units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

STORE_TS = """import { Clock } from './clock';
export interface Reading { at: number }
export type Key = string;
export const enum Mode { Fast, Slow }

export class Gauge extends Base {
  private seen = 0;
  constructor(clock) { super(clock); }
  public async read(key: Key) {
    if (this.seen > 3) {
      return this.reset(key);
    }
  }
  reset(key) { return this.read(key); }
}

abstract class Panel {
  static of() { return new Panel(); }
}
export const half = (x: number) => x / 2;
"""
JOBS_PY = """from queue import Queue
import os.path

class Worker:
    '''Runs jobs.'''

    def start(self, n):
        return run(n)

    async def stop(self):
        pass

def run(n):

    for k in range(n):
        print(k)
    return n

async def later():
    return run(1)
"""
MAIN_JAVA = """import java.util.List;
public class Main {
    public static int size(List<String> xs) {
        return xs.size();
    }
}
"""
FILES = [("samples", "src/gauge.ts", STORE_TS), ("samples", "src/jobs.py", JOBS_PY), ("samples", "src/Main.java", MAIN_JAVA), ("samples", "src/clock.ts", "export function now() {\n  return Date.now();\n}\n"), ("samples", "src/edges.ts", "export function import_edge() {\n  return 1;\n}\n")]


def frame(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FILES, "root string, path string, content string")


def sql_values() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(map(quoted, row)) + ")" for row in FILES)
