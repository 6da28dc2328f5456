"""The visible text of a page is that of all its text nodes, each once, whatever element they are in."""

from pagetrail.plans import extras

HEAD = "<head><title>No</title><style>p {}</style></head>"
BODY = (
    "Loose<h2>Two &amp; a half</h2><ul><li>Item <b>bold</b> end</li></ul><table><tr><td>1 < 2</td></tr></table><p>One<text>inner</text></p>"
    "<button>Go</button><!-- no --><noscript><p>no</p></noscript><template>no</template><script>x = '<p>no</p>'</script><p>Last<br>line  of\ntwo"
)
TASKS = "task_row bigint, actions array<struct<cleaned_html: string>>"


def shown(spark, folder, *pages):
    spark.createDataFrame([(k, [(h,)]) for k, h in enumerate(pages)], TASKS).write.parquet(f"{folder}/tasks.parquet")
    return {r.page_key: r.text for r in extras.visible_text(spark, str(folder)).collect()}


def test_every_text_node_is_kept_once(spark, tmp_path):
    got = shown(spark, tmp_path, f"<html>{HEAD}<body>{BODY}</body></html>", "<div><template>no</div>yes", "<script>no</script>", "", None)
    lines = ["Loose", "Two & a half", "Item", "bold", "end", "1 < 2", "One", "inner", "Go", "Last", "line of two"]
    assert got == {"0:0": "\n".join(lines), "1:0": "yes"}


def test_nodes_of_all_elements_count_up_to_6000(spark, tmp_path):
    items = [f"{i:02d}" + "x" * 98 for i in range(70)]
    got = shown(spark, tmp_path, "<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>")
    assert got == {"0:0": "\n".join(items[:60])[:6000]}
