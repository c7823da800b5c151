"""Spark schemas of the stages."""

RAW_ITEM = "title string, description string, link string, cafename string, postdate string"
POST = "kw string, title string, `desc` string, link string, cafe string, date string"
PREPROCESSED = f"{POST}, idx bigint"
CLASSIFIED = f"{PREPROCESSED}, relevance_score double"
CLUSTERED = f"{CLASSIFIED}, cluster int"
KEYWORD = "id string, kw string, cat string, score int, total bigint, manual boolean"
WORD = "word string, type string"
PERSONA = "name string, situation string, pain_point string, insight string"
PERSONA_CLUSTER = "cluster_id int, cluster_name string, personas array<struct<name:string,situation:string,pain_point:string,insight:string>>"
PERSONA_RESULT = "bk string, personas array<struct<cluster_id:int,cluster_name:string,personas:array<struct<name:string,situation:string,pain_point:string,insight:string>>>>, num_clusters int, total_docs bigint, timestamp string"
SESSION = f"sid string, bk string, problemDef string, step string, ages array<string>, ageRange array<string>, gens array<string>, allKw array<struct<id:string,kw:string,cat:string,score:int,total:bigint,manual:boolean>>, labeledData array<struct<title:string,`desc`:string,cafe:string,kw:string,link:string,label:string>>"
LABELED = "title string, `desc` string, cafe string, kw string, link string, label string"
VECTOR = "id string, `values` array<float>, metadata struct<title:string,`desc`:string,kw:string,cafe:string,cluster:int>"
JOB_EVENT = "sid string, job_type string, ts timestamp, status string, progress double, error string"
JOB_TYPES = ["crawl", "preprocess", "train", "cluster", "embed", "persona"]
NAMING_EXAMPLE = "industry string, cluster string, personas array<string>"
