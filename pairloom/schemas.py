"""Explicit schemas of the datasets; nothing is inferred."""

from pyspark.sql import types as T

ATOMS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "bigint": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp_ntz": T.TimestampNTZType()}


def _parts(text: str) -> list[str]:
    """Text parted at the commas that stand outside all brackets."""
    found, depth = [""], 0
    for c in text:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            found.append("")
        else:
            found[-1] += c
    return [x.strip() for x in found]


def kind(text: str) -> T.DataType:
    """The type that a text such as array<struct<a:int>> names; this works without a session."""
    if text.startswith("array<"):
        return T.ArrayType(kind(text[6:-1]))
    if text.startswith("struct<"):
        return T.StructType([T.StructField(name, kind(of)) for name, _, of in (p.partition(":") for p in _parts(text[7:-1]))])
    return ATOMS[text]


def columns(text: str) -> T.StructType:
    """The schema of a list such as a int, b array<string>."""
    return T.StructType([T.StructField(name, kind(of)) for name, _, of in (p.partition(" ") for p in _parts(text))])


# Names of the sources A, B and C in the data.
A, B, C = "primevul", "sven", "secvuleval"
EVAL_SPLITS = ("primevul_test", "primevul_valid", "sven_val")

LINE_CHANGE = kind("struct<line_no:int,char_start:int,char_end:int,text:string>")
LINES = T.ArrayType(LINE_CHANGE)

SOURCE_A = columns(
    "commit_id string, target int, func string, project string, project_url string, file_name string, commit_message string, cve string, cve_desc string, cwe string, idx long"
)
SOURCE_B = columns(
    "commit_link string, func_name string, file_name string, vul_type string, func_src_before string, func_src_after string, "
    "line_changes struct<deleted:array<struct<line_no:int,char_start:int,char_end:int,line:string>>,added:array<struct<line_no:int,char_start:int,char_end:int,line:string>>>"
)
SOURCE_C = columns(
    "idx long, is_vulnerable boolean, fixed_func_idx double, changed_lines string, func_body string, func_name string, filepath string, project string, project_url string, "
    "commit_id string, cve_list array<string>, cwe_list array<string>, context struct<Explanation:array<string>>, commit_message string"
)
PAIR_COLUMNS = "source pair_id commit_id project project_url func_name filepath vuln_hash vuln_func patched_func cve cwe cve_desc commit_message deleted_lines added_lines source_row_idx".split()
PAIR = columns(
    "source string, pair_id string, commit_id string, project string, project_url string, func_name string, filepath string, vuln_hash string, vuln_func string, patched_func string, "
    "cve array<string>, cwe array<string>, cve_desc string, commit_message string, deleted_lines array<struct<line_no:int,char_start:int,char_end:int,text:string>>, "
    "added_lines array<struct<line_no:int,char_start:int,char_end:int,text:string>>, source_row_idx long"
)
TEACHER = columns(
    "pair_id string, commit_id string, func_name string, vuln_hash string, source string, is_vulnerable boolean, code string, prompt string, generated_response string, "
    "ground_truth_lines array<int>, parsed_classification string, parsed_important_lines array<long>"
)
RESPONSE = columns(
    "commit_id string, pair_id string, source string, split string, is_vulnerable boolean, target int, prompt_type string, prompt string, response string, "
    "ground_truth_lines array<struct<line_no:int,char_start:int,char_end:int,text:string>>"
)
COMPLETION = columns(
    "call_num long, timestamp timestamp_ntz, data_source string, is_vulnerable boolean, ground_truth_lines array<int>, completion_length long, completion string, reward double, extra_info string"
)
PARSED = kind("struct<classification:string,lines:array<bigint>,status:string>")
ROLLOUT = columns("output string, gts string, score double")
