"""The registered queries: one per operator of the survey, over the derived wardrobe tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perchero import lookups as L
from perchero import schemas as S
from perchero.functions import expert, features, rules, text
from perchero.functions.hashing import draw_below
from perchero.operators import candidates, changes, dataset, evaluate, generate, ml, recommend
from perchero.operators import wardrobe
from perchero.operators.trees import Ensemble
from perchero.session import dealt_by_part_of_keys, scratch_path
from perchero.sources import tables
from perchero.sources.storage import write_table
from perchero.sources.testdata import TestTables, load
from perchero.streaming.recommend_stream import read_stream, recommend_stream

QUERIES: dict[str, Callable[[TestTables], DataFrame]] = {}
DECIMALS = 6


def query(build: Callable[[TestTables], DataFrame]) -> Callable[[TestTables], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def rounded(name: str | Column, alias: str | None = None) -> Column:
    column = F.col(name) if isinstance(name, str) else name
    return F.round(column, DECIMALS).alias(alias or name)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(build):
        return lambda spark, sf_dir: build(load(spark, sf_dir))

    return {name: bind(build) for name, build in QUERIES.items()}


# --- sources and table maintenance ------------------------------------------------------------

@query
def scan_users(t: TestTables) -> DataFrame:
    return t.users


@query
def profile_projection(t: TestTables) -> DataFrame:
    return wardrobe.profiles(t.users, t.accounts)


@query
def scan_csv(t: TestTables) -> DataFrame:
    """Garments written as CSV, columns in another order and one more, and read back by name."""
    path = scratch_path(t.spark, "csv")
    turned = t.garments.select(*reversed(t.garments.columns), F.lit("x").alias("further"))
    tables.write_csv(turned, path)
    return tables.read_csv(t.spark, path, S.GARMENTS)


@query
def garments_by_user(t: TestTables) -> DataFrame:
    return wardrobe.garments_of(t.garments, t.requests)


@query
def request_user_join(t: TestTables) -> DataFrame:
    return recommend.request_users(t.requests, t.users)


@query
def context_log(t: TestTables) -> DataFrame:
    """Stored contexts plus the rows that answering the messages appends."""
    new = recommend.context_log(recommend.read_messages(t.messages, t.users))
    stored = t.contexts.select(
        F.lit("stored").alias("source"), F.col("context_id").alias("source_id"), "user_id",
        *S.CONTEXT_ATTRIBUTES,
    )
    return stored.unionByName(
        new.withColumn("source", F.lit("message")).withColumnRenamed("message_id", "source_id")
    )


@query
def garment_insert_defaults(t: TestTables) -> DataFrame:
    return changes.inserted_garments(t.garment_changes)


@query
def garment_form_clean(t: TestTables) -> DataFrame:
    return changes.clean_form_uploads(t.uploads)


@query
def garment_apply_changes(t: TestTables) -> DataFrame:
    return changes.apply_garment_changes(t.garments, t.garment_changes)


@query
def garment_delete(t: TestTables) -> DataFrame:
    kept = changes.delete_garments(t.garments, t.garment_changes)
    return kept.select("garment_id", "user_id", "name")


@query
def register_dedupe(t: TestTables) -> DataFrame:
    return changes.accept_registrations(t.registrations, t.existing_accounts)


@query
def profile_apply_changes(t: TestTables) -> DataFrame:
    return changes.apply_profile_changes(t.users, t.profile_changes)


@query
def image_ext_filter(t: TestTables) -> DataFrame:
    name = F.coalesce("filename", F.lit(""))
    return t.uploads.select(
        "upload_id", "filename", text.extension(name).alias("extension"),
        text.allowed_image(name).alias("allowed"),
    )


# --- wardrobes --------------------------------------------------------------------------------

@query
def classify_garments(t: TestTables) -> DataFrame:
    return t.garments.select(
        "garment_id", "type", text.garment_group(F.col("type")).alias("type_group")
    )


@query
def garment_meta_lookup(t: TestTables) -> DataFrame:
    rows = wardrobe.with_meta(t.garments.select("garment_id", "type"))
    drawn = (draw_below(F.col("garment_id"), "base", 5) + 1).cast("int")
    return rows.select(
        "garment_id", "type", "role",
        F.coalesce("base_formality", drawn).alias("base_formality"),
    )


@query
def wardrobe_fallback_lookup(t: TestTables) -> DataFrame:
    return wardrobe.with_palette(t.users).select(
        "user_id", "style_preference", "gender", "palette_gender",
        F.concat_ws(",", "types").alias("types"),
    )


@query
def off_palette_colors(t: TestTables) -> DataFrame:
    return wardrobe.with_palette(t.users).select(
        "user_id", F.concat_ws(",", "off_colors").alias("off_colors")
    )


@query
def user_wardrobe_nested(t: TestTables) -> DataFrame:
    """Pages of at most 50 garments, flattened for comparison."""
    ids = F.transform("garments", lambda g: g["garment_id"].cast("string"))
    return wardrobe.wardrobe_pages(t.garments).select(
        "user_id", "page", F.size("garments").alias("n"),
        F.concat_ws(",", ids).alias("garment_ids"),
    )


@query
def wardrobe_counts(t: TestTables) -> DataFrame:
    return wardrobe.wardrobe_counts(t.garments)


@query
def users_complete_wardrobe(t: TestTables) -> DataFrame:
    return wardrobe.complete_users(t.garments).select("user_id")


# --- generation and rating ----------------------------------------------------------------------

def _user_keys(t: TestTables) -> DataFrame:
    return t.raw("customer").select(F.col("c_custkey").alias("user_id"))


@query
def users_generate(t: TestTables) -> DataFrame:
    return generate.users(_user_keys(t))


@query
def garments_generate(t: TestTables) -> DataFrame:
    return generate.wardrobes(generate.users(_user_keys(t)))


@query
def contexts_generate(t: TestTables) -> DataFrame:
    return generate.contexts(t.raw("orders").select(F.col("o_orderkey").alias("context_id")))


@query
def ratings_generate(t: TestTables) -> DataFrame:
    return t.ratings


@query
def ratings_limited(t: TestTables) -> DataFrame:
    """The generator's limits: so many attempts, and so many distinct outfits of them."""
    return generate.limited_outfits(
        t.rating_attempts(), t.garments, L.MAX_RATINGS, L.MAX_ATTEMPTS)


@query
def ratings_dedupe(t: TestTables) -> DataFrame:
    return generate.unique_outfits(generate.draw_outfits(t.rating_attempts(), t.garments))


def _expert_rows(t: TestTables, *columns: Column | str) -> DataFrame:
    """Columns over the rated outfits with all inputs of the expert; stored."""
    outfits = t.ratings.select(*[c for c in S.RATINGS.names if c != "rating"])
    full = dataset.join_outfits(outfits, t.users, t.contexts, t.garments, roles=True, drawn=True)
    with dealt_by_part_of_keys(t.spark):
        return write_table(
            expert.add_inputs(full).select(*columns), scratch_path(t.spark, "expert"))


@query
def expert_rating_parts(t: TestTables) -> DataFrame:
    parts = [rounded(c, n) for n, c in expert.expert_parts().items()]
    return _expert_rows(t, "rating_id", *parts)


@query
def expert_rating(t: TestTables) -> DataFrame:
    score, noise = expert.expert_score(), expert.noise(F.col("rating_id"))
    return _expert_rows(
        t, "rating_id", rounded(score, "score"), rounded(noise, "noise"),
        expert.to_rating(score + noise).alias("rating"),
    )


# --- training table and features ----------------------------------------------------------------

@query
def full_dataset(t: TestTables) -> DataFrame:
    return t.full


@query
def dataset_shape(t: TestTables) -> DataFrame:
    return evaluate.dataset_shape(t.full)


def _features(t: TestTables, columns: dict[str, Column]) -> DataFrame:
    return t.full.select("rating_id", *[rounded(c, n) for n, c in columns.items()])


@query
def match_features(t: TestTables) -> DataFrame:
    return _features(t, features.match_columns())


@query
def formality_diffs(t: TestTables) -> DataFrame:
    return _features(t, features.diff_columns())


@query
def style_match_train(t: TestTables) -> DataFrame:
    return _features(t, {"style_match": features.style_match("train")})


@query
def style_match_serve(t: TestTables) -> DataFrame:
    return _features(t, {"style_match": features.style_match("serve")})


@query
def seasonal_fit(t: TestTables) -> DataFrame:
    return _features(t, {"seasonal_appropriateness": features.seasonal_appropriateness()})


@query
def temp_material_fit(t: TestTables) -> DataFrame:
    return _features(t, {"temp_material_match": features.temp_material_match()})


@query
def full_features(t: TestTables) -> DataFrame:
    rows = features.add_features(t.full)
    shares = [rounded(n) for n in
              ("style_match", "seasonal_appropriateness", "temp_material_match")]
    whole = [*features.match_columns(), *features.diff_columns()]
    texts = [f"{r}_description" for r in L.ROLES]
    return rows.select("rating_id", *whole, *shares, *texts)


def _matrix(t: TestTables) -> DataFrame:
    return dataset.feature_matrix(dataset.drop_ids(features.add_features(t.full)))


@query
def feature_matrix(t: TestTables) -> DataFrame:
    rows = _matrix(t)
    shares = {"style_match", "seasonal_appropriateness", "temp_material_match"}
    return rows.select(*[rounded(c) if c in shares else F.col(c) for c in rows.columns])


# --- rules --------------------------------------------------------------------------------------

@query
def garment_flags(t: TestTables) -> DataFrame:
    flags = [c.alias(n) for n, c in rules.garment_flags().items()]
    return t.garments.select("garment_id", *flags)


@query
def rule_bonus_parts(t: TestTables) -> DataFrame:
    parts = [rounded(c, n) for n, c in rules.bonus_parts().items()]
    return rules.add_rule_inputs(t.full).select("rating_id", *parts)


@query
def rule_bonus(t: TestTables) -> DataFrame:
    return rules.add_rule_inputs(t.full).select(
        "rating_id", rounded(rules.raw_bonus(), "raw_bonus"),
        rounded(rules.rule_bonus(), "bonus"),
    )


# --- candidates and recommendations ---------------------------------------------------------------

@query
def candidate_triples(t: TestTables) -> DataFrame:
    return candidates.candidate_counts(t.requests, t.users, t.garments).select(
        "request_id", "n_outfits", "sum_formality"
    )


@query
def candidate_features(t: TestTables) -> DataFrame:
    rows = candidates.candidate_features(t.requests, t.users, t.garments)
    totals = [rounded(c) for c in rows.columns if c.startswith("sum_")]
    return rows.select("request_id", "n_outfits", *totals)


@query
def avoid_filter(t: TestTables) -> DataFrame:
    return candidates.request_garments(t.requests, t.garments).select(
        "request_id", "garment_id", "violates"
    )


@query
def avoid_skipped_count(t: TestTables) -> DataFrame:
    return candidates.avoid_counts(t.requests, t.garments)


@query
def score_requests(t: TestTables) -> DataFrame:
    rows = candidates.outfit_statistics(
        t.requests, t.users, t.garments, candidates.expert_predictor()
    )
    scores = [rounded(c) for c in ("min_final", "max_final", "sum_final")]
    return rows.select("request_id", "n_outfits", *scores)


def _ranked(rows: DataFrame) -> DataFrame:
    scores = [rounded(c) for c in ("prediction", "bonus", "final")]
    return rows.select(*[c for c in rows.columns if c not in ("prediction", "bonus", "final")],
                       *scores)


@query
def best_outfit(t: TestTables) -> DataFrame:
    return _ranked(recommend.best_outfits(
        t.requests, t.users, t.garments, candidates.expert_predictor()
    ))


@query
def top3_outfits(t: TestTables) -> DataFrame:
    return _ranked(recommend.rank_outfits(
        t.requests, t.users, t.garments, candidates.expert_predictor(), 3
    ))


@query
def recommend_response(t: TestTables) -> DataFrame:
    rows = recommend.respond(
        t.messages, t.users, t.garments, candidates.expert_predictor()
    )
    garments = [
        F.col(f"outfit.{r}.{f}").alias(f"{r}_{f}")
        for r in L.ROLES for f in ("id", *recommend.OUTFIT_FIELDS)
    ]
    return rows.select("message_id", "status", "predicted_rating", *garments, "fixed_reply", "reply_prompt")


# --- text -----------------------------------------------------------------------------------------

@query
def greeting_flag(t: TestTables) -> DataFrame:
    return t.chat_texts.select(
        "source", "text_id", text.is_greeting(F.col("text")).alias("is_greeting")
    )


@query
def json_extract(t: TestTables) -> DataFrame:
    found = text.embedded_json(F.col("llm_reply"))
    return t.messages.select(
        "message_id", found.alias("json_text"),
        text.parse_reply(F.col("llm_reply")).isNotNull().alias("is_valid"),
    )


@query
def context_normalize(t: TestTables) -> DataFrame:
    rows = text.with_context(t.messages)
    return rows.select(
        "message_id", "is_greeting", *[F.col(f"context.{c}") for c in S.CONTEXT_ATTRIBUTES],
        F.concat_ws("|", "context.avoid_items").alias("avoid_items"),
    )


@query
def avoid_normalize(t: TestTables) -> DataFrame:
    """Avoid terms of every parsable reply, whatever the message says."""
    rows = t.messages.withColumn("_reply", text.parse_reply(F.col("llm_reply")))
    rows = rows.withColumn("_entry", text.entry(F.col("_reply"), "avoid_items", listed=True))
    terms = text.to_terms(F.col("_entry"))
    return rows.select(
        "message_id", F.size(terms).alias("n_terms"), F.concat_ws("|", terms).alias("terms")
    )


@query
def prompt_build(t: TestTables) -> DataFrame:
    """Extraction prompt, and the reply prompt when no outfit was found."""
    rows = text.with_context(t.messages)
    garment = "struct<" + ",".join(f"{f}:string" for f in recommend.OUTFIT_FIELDS) + ">"
    nothing = F.lit(None).cast("struct<" + ",".join(f"{r}:{garment}" for r in L.ROLES) + ">")
    reply = text.reply_prompt(
        F.col("message"), F.col("context"), nothing, F.lit(None).cast("double")
    )
    return rows.select(
        "message_id", text.extraction_prompt(F.col("message")).alias("extraction_prompt"),
        reply.alias("reply_prompt"),
    )


# --- evaluation -------------------------------------------------------------------------------------

@query
def train_test_split(t: TestTables) -> DataFrame:
    return t.ratings.select("rating_id", evaluate.is_test(F.col("rating_id")).alias("is_test"))


@query
def stratified_folds(t: TestTables) -> DataFrame:
    return evaluate.stratified_folds(t.ratings.select("rating_id", "rating"))


@query
def baseline_mean_median(t: TestTables) -> DataFrame:
    train, _ = evaluate.split(t.ratings)
    rows = evaluate.mean_median(train)
    return rows.select(rounded("mean_rating"), rounded("median_rating"))


@query
def baseline_metrics(t: TestTables) -> DataFrame:
    rows = evaluate.baseline_metrics(*evaluate.split(t.ratings))
    return rows.select("baseline", "n", *[rounded(c) for c in ("mae", "mape", "rmse", "r2")])


@query
def cv_fold_metrics(t: TestTables) -> DataFrame:
    folded = evaluate.stratified_folds(t.ratings.select("rating_id", "rating"))
    rows = evaluate.fold_metrics(folded)
    return rows.select("fold", "n", rounded("mape"), rounded("mae"))


@query
def scaler_stats(t: TestTables) -> DataFrame:
    rows = evaluate.scaler_statistics(_matrix(t))
    return rows.select("feature", rounded("mean"), rounded("std"))


@query
def category_vocab(t: TestTables) -> DataFrame:
    return evaluate.category_vocabulary(_matrix(t))


def _predicted(t: TestTables) -> DataFrame:
    rows = _expert_rows(t, "rating_id", expert.expert_prediction().alias("prediction"))
    return rows.join(t.ratings.select("rating_id", "rating"), "rating_id")


@query
def prediction_histogram(t: TestTables) -> DataFrame:
    rows = evaluate.histogram(_predicted(t))
    return rows.select("bin", rounded("bin_low"), "n")


@query
def actual_vs_predicted(t: TestTables) -> DataFrame:
    rows = evaluate.actual_vs_predicted(_predicted(t))
    numbers = ["mean_prediction", "min_prediction", "max_prediction", "correlation"]
    return rows.select("rating", "n", *[rounded(c) for c in numbers])


# --- models and streams (no SQL counterpart) ------------------------------------------------------

def _final_model(t: TestTables) -> Ensemble:
    """The stored winner fitted on all ratings, published once per application."""
    registry = ml.Registry(t.spark, f"{t.store}/models")
    model = registry.current()
    if model is None:
        model = ml.fit(t.training, L.BEST_PARAMS)
        registry.publish(model)
    return model


@query
def ml_train_metrics(t: TestTables) -> DataFrame:
    return ml.train_metrics(t.training, L.BEST_PARAMS)[1]


@query
def ml_training_summary(t: TestTables) -> DataFrame:
    """Test metrics and final cross-validation of the stored winner in one row."""
    return ml.training_summary(t.training, L.BEST_PARAMS)


@query
def ml_feature_importance(t: TestTables) -> DataFrame:
    return ml.feature_importance(_final_model(t).node_table(t.spark))


@query
def ml_search_results(t: TestTables) -> DataFrame:
    """The trials that finish within the search's budget."""
    return ml.search(ml.prepare(t.training), ml.draw_params(ml.SEARCH_TRIALS))[0]


@query
def ml_scored_outfits(t: TestTables) -> DataFrame:
    """The three best outfits of every request by model prediction plus bonus."""
    return recommend.rank_outfits(
        t.requests, t.users, t.garments, candidates.model_predictor(_final_model(t)), 3
    )


@query
def stream_recommend(t: TestTables) -> DataFrame:
    """All requests through the file stream."""
    spark = t.spark
    source, out = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-out")
    t.requests.write.parquet(source)
    running = recommend_stream(
        read_stream(spark, source, t.requests.schema, files_per_trigger=1000),
        t.users, t.garments, candidates.expert_predictor(), out,
        scratch_path(spark, "stream-state"),
    )
    running.awaitTermination()
    return _ranked(spark.read.parquet(out).drop("batch"))
