"""A small rule set that shows every feature of the schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.operators.lexical import RULES

#: Layer, order, term, targets, type, English, severity, disabled, clues, negative clues, tags.
ROWS = [
    (0, 1, "數據", ["資料"], "cross_strait", "data", "warning", False, [], [], ["it"]),
    (0, 2, "數據庫", ["資料庫"], "cross_strait", "database", "warning", False, [], [], ["it"]),
    (0, 3, "信息", ["資訊"], "cross_strait", "information", "warning", False, [], [], ["it"]),
    (0, 4, "軟件", ["軟體"], "cross_strait", "software", "warning", False, [], [], ["it"]),
    (0, 5, "文件", ["檔案", "文件"], "confusable", "file", "warning", False, ["打開"], [], ["it"]),
    (0, 6, "視頻", ["影片"], "cross_strait", "video", "warning", False, [], [], ["media"]),
    (0, 7, "質量", ["品質"], "confusable", "quality", "warning", False, [], ["物理"], []),
    (0, 8, "网络", ["網路"], "cross_strait", "network", "error", False, [], [], ["it"]),
    (0, 9, "默認", ["預設"], "cross_strait", "default", "warning", False, [], [], ["it"]),
    (0, 10, "程序", ["程式"], "cross_strait", "program", "warning", False, ["打印", "服務器"], [], ["it"]),
    (0, 11, "打印", ["列印"], "cross_strait", "print", "warning", False, [], [], ["it"]),
    (0, 12, "圖像", ["影像"], "cross_strait", "image", "info", False, [], [], ["media"]),
    (0, 13, "服務器", ["伺服器"], "cross_strait", "server", "error", False, [], [], ["it"]),
    (0, 14, "內存", ["記憶體"], "cross_strait", "memory", "warning", False, [], [], ["it"]),
    (0, 15, "總而言之", [""], "ai_filler", None, "info", False, [], [], ["style"]),
    (0, 16, "項目", ["專案"], "cross_strait", "project", "warning", False, [], [], []),
    (0, 17, "進行測試", ["測試"], "ai_style", None, "info", False, [], [], ["style"]),
    (1, 1, "圖像", ["圖片"], "cross_strait", "image", "warning", False, [], [], ["media"]),
    (1, 2, "項目", ["專案"], "cross_strait", "project", "warning", True, [], [], []),
]


#: Rules that show what a rule may ask of a match's surroundings: those of ROWS and further exceptions, clues
#: with a direction, groups, guard and confidence.
FEATURES = [
    (0, 1, "積分", ["點數"], "cross_strait", "points", "warning", False, [], [], [], [], [], [], None, None),
    (0, 2, "程序", ["程式"], "cross_strait", "program", "warning", False, [], [], [], ["程序員"], [], [], None, "low"),
    (0, 3, "文件夾", ["資料夾"], "cross_strait", "folder", "warning", False, [], [], [], [], [], [], None, None),
    (0, 4, "文件", ["檔案", "文件"], "confusable", "file", "warning", False, [], [], [], [], ["before:打開"], [], None, None),
    (0, 5, "數據", ["數據集", "資料"], "confusable", "data", "warning", False, [], [], [], [], ["adjacent:很"], [], None, None),
    (0, 6, "視頻", ["影片", "短片"], "cross_strait", "video", "warning", False, [], [], [], [], [], [(["會議"], ["視訊"]), ([], ["壞"]), (["好"], [""])], None, None),
    (0, 7, "總而言之", [""], "ai_filler", None, "info", False, [], [], [], [], [], [], None, None),
    (0, 8, "研究顯示", [""], "ai_filler", None, "info", False, [], [], [], [], [], [], "attribution", None),
    (0, 9, "裏", ["裡"], "variant", None, "warning", False, [], [], [], [], [], [], None, None),
    (0, 10, "內地", ["中國"], "political_coloring", "mainland", "error", False, [], [], [], [], [], [], None, None),
    (0, 11, "進程", ["行程", "處理程序"], "cross_strait", "process", "warning", False, [], [], [], [], [], [], None, None),
    (0, 12, "線程", ["執行緒"], "cross_strait", "thread", "warning", False, ["進程", "硬件"], [], [], [], [], [], None, None),
    (0, 13, "令牌", ["權杖", "符記"], "cross_strait", "token", "warning", False, [], [], [], [], [], [], None, None),
    (0, 14, "硬件", ["硬體"], "cross_strait", "hardware", "warning", False, ["線程", "軟件"], [], [], [], [], [], None, None),
]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*r, [], [], [], None, None) for r in ROWS], RULES)


def features(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FEATURES, RULES)


def _list(values: list[str], kind: str = "VARCHAR[]") -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + f"]::{kind}"


VALUES = ", ".join(f"({a}, {b}, '{c}', {_list(d)}, '{e}', {'NULL' if f is None else repr(f)}, '{g}', {h}, {_list(i)}, {_list(j)}, {_list(k)})" for a, b, c, d, e, f, g, h, i, j, k in ROWS)
SQL = f"""seeds(layer, ord, term, target, type, english, severity, disabled, clues, negative_clues, tags) AS (VALUES {VALUES}),
rules AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY layer DESC, ord DESC) AS n FROM seeds) WHERE n = 1 AND NOT disabled)"""
