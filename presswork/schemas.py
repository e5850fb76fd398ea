"""Table schemas; readers never infer them."""

ARTICLES = "id bigint, title string, url string, source string, summary string, authors string, doi string, external_id string, content_hash string, embedding array<double>, kg_extracted_at timestamp_ntz, published_at timestamp_ntz, fetched_at timestamp_ntz"
INGESTION_RUNS = "id bigint, started_at timestamp_ntz, finished_at timestamp_ntz, added_total int, error_count int, detail struct<added:map<string,int>,errors:map<string,string>,embedded:int,entities_extracted:int>"
USERS = "id bigint, email string, apple_user_id string, google_user_id string, display_name string, created_at timestamp_ntz, updated_at timestamp_ntz"
INTERACTIONS = "id bigint, user_id bigint, article_id bigint, interaction_type string, read_time_seconds int, search_query string, created_at timestamp_ntz"
USER_EMBEDDINGS = "user_id bigint, embedding array<double>, updated_at timestamp_ntz, interaction_count int"
ENTITIES = "id bigint, name string, entity_type string, external_source string, external_id string, aliases array<string>, created_at timestamp_ntz"
MENTIONS = "article_id bigint, entity_id bigint, mention_text string, created_at timestamp_ntz"
RELATIONS = "subject_entity_id bigint, predicate string, object_entity_id bigint, evidence_article_id bigint, created_at timestamp_ntz"
EVENTS = "article_id bigint, kind string, score double, detail struct<related_article_ids:array<bigint>,related_sources:array<string>,window_hours:int,similarity_threshold:double,mean_similarity:double>, detected_at timestamp_ntz"

#: What listings show: neither vectors nor hashes.
ARTICLE_COLUMNS = ["id", "title", "url", "source", "summary", "authors", "doi", "external_id", "published_at", "fetched_at"]
EMBEDDING_DIM = 768
