"""Chinese for the driver's documents, which have none: a passage by its number stands before its whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts written for these queries.
TEXTS = [
    "這個數據庫的信息很多，我們用軟件打開文件。\n第二行有數據,也有視頻!",
    "他们说这个软件的质量很好，网络也快。",
    "總而言之，這是一個重要的的問題。綜上所述，被看見被聽見被記得被遺忘被想起的人不少。",
    "蘋果，香蕉，橘子，西瓜，都是水果。我喜歡蘋果。我吃香蕉。我買西瓜。",
    "今天有３個API呼叫，使用C P U和GPU計算,結果是100~200元。",
    "你好，您也好。。。。請稍等!!真的嗎？？我不知道……",
    "研究研究這件事情這件事情再說。北京-上海的列車，三~五天。",
    "值得注意的是，公司的經理的朋友的孩子的老師來了。他來了。他們走了。她笑了。",
    "默認的程序會打印圖像，服務器的內存不足。\n\n第一段——很長——真的——完了。\n\n第二段——也有——三個——破折號。\n\n第三段——還是——這樣——寫。",
    "Plain text, no ideographs... and @someone wrote it.",
    "進行測試，使用 Github 和 javascript 的項目。",
    "你是不是要去嗎？她是漂亮。我們來了和他們說話。他們和我們一樣。我們討論了關於價格的事。對資料進行分析。根據研究顯示，根據報告表示式的寫法。",
    "敬啟者：因為下雨所以停辦。予以處理。當我來的時候，他走了。",
    "因為下雨所以停辦。予以處理。當時他說的時候。如果你來那麼我走。這是最好的方法之一。他是最好的作家之一。經濟的減少導致了問題。我會來，如果明天沒有事情的話。",
    "系統作為核心，他有所作為。這個程式擁有權限，也被廣泛使用。的故事告訴我們。領先時代10年。不只是速度，而是品質。儘管有挑戰，團隊仍然努力。從北到南再到東西兩邊都有。",
    "實際上，基本上他明顯地不同，誠實地說（honestly）沒事。仔細的看，慢慢地走。透過改善的提升，分析的理解的發現都有。他是一位很好的老師。5年前他曾已看過了。這意味著因此要改。",
    "# 結論與展望\n- **甲**：請看\n- **乙**：請聽\n- **丙**：請說\n\n## 挑戰與機遇\n1. 請開\n2. 請關\n3. 請等\n\n一——二——三。紅色、白色、黑色。\n\n由此可見\n\n這反映了\n\n不難發現",
    "然後啊就是這個嘛，其實他說的話我覺得還可以啦然後就這樣呢。這件事情的結果就是大家都同意要把所有的資料都放進同一個地方去保存起來了。他走了。她哭了。我笑了。\n\n- 甲\n\n- 乙\n\n- 丙\n\n完",
    "他說「這樣『很好』」，又說『外面「裡面」』。「沒有結束。\n\n（半邊）與(ascii)和（錯」。e\u0301 與 é，連結 https://example.org/a_b?c=1「」 和 ./src/main.txt。",
    "正文 <!-- glyphmill:disable-next -->\n軟件\n<!-- glyphmill:disable-block -->\n信息\n<!-- glyphmill:enable -->\n視頻 // glyphmill:ignore\n數據 ，好 。 是\n```\n軟件\n~~~\n```\n`軟件` 和 [網路](https://a.b/c) <b>視頻</b>。是的.\n「軟件」一詞，『信息』是大陸的用語",
    "---\ntitle: 軟件\nlang: zh\n---\n:::note\n信息.\n:::\n# 軟件標題\nGITHUB 和 JavaScript 與 Javascripts 及 github",
    "他說“你好‘嗎’”。她引用了：“Do one thing.”他按\"Enter\"鍵，又寫\"x y\"。\n\n設定“font”屬性，而“再見“是錯的。",
    "中文(註解)好(abc)中(巢(狀)的)字。他說:好,I agree, 對;時間 12:30 開始:是\n: 定義\n上海(1957 年)也好(嗎)。",
    "头发和皇后的发现，以后里面干净。他们几乎只是准备着复杂的系统，裏面。",
    "| 甲 | 乙 |\n| --- | --- |\n| 軟件 | b |\n| c | 信息 |\n\n標題\n===\n\n---\n# 節的軟件\n> # 引\n```\n# no\n```",
    "a\u200b軟件，\ufeffb\u00ad。👩\u200d🚀 x\u200dy 好\U000e0100字 c\U000e0100 \u200e 尾\u2060",
    "研究顯示成果很好。中央氣象署專家認為會下雨。研究顯示[1]很好。根據研究顯示如此。研究顯示器很貴。專家指出，這很好 https://a.b/c。",
    "越來越好，越走越遠的人生啊。\n\n這條線是一條線，這條線會延伸。\n\n越來越好，越走越遠的人生啊。\n\n你以為很快嗎？錯了。為什麼會慢？因為沒有想。\n\n**甲**和**乙**都很好。\n\n展望未來，值得期待。",
    "雖然很快，但很貴。儘管如此，卻好。不僅快，更好。即使下雨，不過還好。不只好，也快。這奠定了理論基礎。隨著科技不斷發展。",
    "這是一個在昨天下午的會議中由大家共同提出的非常重要的建議。他看到的在早上的時候出現的那個很好的人。",
    "累積分佈很好，積分也好。這個程序員寫程序。文件夾裡的文件打開了。總而言之，數據集很大，數據很多。視頻會議的視頻，\n\n視頻。",
    "在某種程度上，可以說是好的；相對而言，從某個角度來看也可以說是好的，在某種程度上很好很好很好很好很好。他說「可以說是」。",
    "進程的排程很慢。學習的進程。\n\n進程很多，線程也是，而且內地的硬件好。這個令牌與中間件的接口。",
    "她在心裏說，這裏很好。",
    "這個軟件和那個軟體不同，信息就是資訊，視頻不是影像。",
    "這是最好的方法之一，也是最快的方法之一，" + "用起來很順手而且看起來很清楚，" * 6 + "所以大家都喜歡。",
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A passage by each document's number, a blank line, and the document's whole own text."""
    texts = F.array(*[F.lit(t) for t in TEXTS])
    own = F.element_at(texts, (F.pmod("doc_id", F.lit(len(TEXTS))) + 1).cast("int"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.concat(own, F.lit("\n\n"), F.coalesce("text", F.lit(""))).alias("text"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


SQL = "d AS (SELECT doc_id, CASE doc_id % " + str(len(TEXTS)) + " " + " ".join(f"WHEN {i} THEN {_quoted(t)}" for i, t in enumerate(TEXTS)) + " END || chr(10) || chr(10) || coalesce(text, '') AS text FROM documents)"
