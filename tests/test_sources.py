import os

from tessera.session import scratch_path
from tessera.sources import tables as A


def test_read_documents_encodings(spark):
    d = scratch_path(spark, "docs").replace("file:", "")
    os.makedirs(d)
    text = "Größe café naïve"
    files = {"u8.txt": text.encode("utf-8"), "l1.txt": text.encode("iso-8859-1"),
             "u16le.txt": b"\xff\xfe" + text.encode("utf-16-le"), "u16be.txt": b"\xfe\xff" + text.encode("utf-16-be")}
    for name, data in files.items():
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    got = {os.path.basename(r.path): r.text for r in A.read_documents(spark, d).collect()}
    assert got == {name: text for name in files}


def test_read_sequences_separators(spark):
    d = scratch_path(spark, "steps").replace("file:", "")
    os.makedirs(d)
    with open(os.path.join(d, "pipe.csv"), "w") as f:
        f.write("input|action|option|next_df\n{full_prompt}|llm_completion|{'max_length': 486}|next\n"
                "a|b in input|user_input||tables/x.csv\n")
    with open(os.path.join(d, "tab.csv"), "w") as f:
        f.write("input\taction\toption\tnext_df\n{result}\tuser_input\t{}\tnext\n")
    rows = sorted((os.path.basename(r.file), r.step_no, r.input, r.action, r.option, r.next_df)
                  for r in A.read_sequences(spark, d).collect())
    assert rows == [("pipe.csv", 0, "{full_prompt}", "llm_completion", "{'max_length': 486}", "next"),
                    ("pipe.csv", 1, "a|b in input", "user_input", "", "tables/x.csv"),
                    ("tab.csv", 0, "{result}", "user_input", "{}", "next")]


def test_save_and_load_result(spark):
    store = scratch_path(spark, "store")
    df = spark.createDataFrame([(1, "a;b"), (2, "c")], "k int, v string")
    A.save_result(df, store, "r1", fmt="csv", sep=";")
    back = A.load_result(spark, store, "r1", view="df", fmt="csv", sep=";")
    assert sorted(tuple(r) for r in back.collect()) == [(1, "a;b"), (2, "c")]
    assert spark.sql("SELECT count(*) FROM df").first()[0] == 2
