"""The engine's façade: models, corpus state and questions in one place.

Every method takes and returns DataFrames; questions come in batches.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import channel as C
from corpusloom.functions import lists as L
from corpusloom.functions import text as X
from corpusloom.operators import correct, ngram, predict, wordvectors
from corpusloom.streaming import changes, livecache, personal


@dataclass(frozen=True)
class Settings:
    # fixed values: the defaults of the settings that results depend on
    alpha: float = L.ALPHA
    beta: float = 1.5
    threshold: float = 2.5
    min_count: int = 2
    suggestions: int = 3
    gamma: float = L.CACHE_GAMMA
    personalized: bool = True  # off: what was learned is neither used nor added to, but stays
    learned: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()


@dataclass
class Engine:
    spark: SparkSession
    settings: Settings = field(default_factory=Settings)
    world: ngram.Counts | None = None
    state: DataFrame | None = None
    lexicon: DataFrame | None = None  # (w): real words that models may lack, such as files.word_list gives
    own: personal.Personal | None = None  # what is learned of the typist
    user: str | None = None
    caches: DataFrame | None = None  # (doc, w, c)

    def load_global_text(self, docs: DataFrame, text_col: str = "text") -> None:
        self.world = ngram.model(docs, text_col)

    def load_global(self, counts: ngram.Counts) -> None:
        self.world = counts

    def rebuild_personal(self, notes: DataFrame) -> None:
        """notes(path, text)."""
        self.state = changes.path_counts(notes.select("path", "text"))

    def change(self, batch: DataFrame) -> None:
        """set, remove or rename files: (op, path, text, seq)."""
        self.state = changes.applied(self.state if self.state is not None else self.spark.createDataFrame([], changes.STATE), batch)

    @property
    def personal(self) -> ngram.Counts | None:
        return None if self.state is None else ngram.prune(changes.totals(self.state), self.settings.min_count)

    @property
    def model(self) -> ngram.Counts:
        """The model that spelling asks: the global one, or the personal where there is no other."""
        found = self.world or self.personal
        if found is None:
            raise ValueError("no model is loaded")
        return found

    def log_prob(self, asked: DataFrame) -> DataFrame:
        """asked(w2, w1, w) with log_prob under the mixture of the global and the personal model."""
        personal = self.personal
        if self.world is None or personal is None or self.settings.alpha <= 0:
            return ngram.log_prob(self.model, asked)
        both = ngram.log_prob(personal, ngram.log_prob(self.world, asked, name="g"), name="p")
        return both.select(*asked.columns, ngram.mixed(F.col("g"), F.col("p"), self.settings.alpha).alias("log_prob"))

    def predict(self, contexts: DataFrame, k: int | None = None) -> DataFrame:
        """(w2, w1, w, log_prob, rank): both models' candidates, scored by the mixture."""
        k = k or self.settings.suggestions
        personal = self.personal
        if self.world is None or personal is None or self.settings.alpha <= 0:
            return ngram.predict(self.model, contexts, k)
        pool = ngram.predict(self.world, contexts, 3 * k).select("w2", "w1", "w").unionByName(ngram.predict(personal, contexts, 3 * k).select("w2", "w1", "w")).distinct()
        order = Window.partitionBy("w2", "w1").orderBy(F.desc(F.round("log_prob", 9)), "w")
        scored = self.log_prob(pool).where(~X.is_profane("w", self.settings.allowed))
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def learned(self) -> DataFrame:
        """What may be used of the user's state: none while personalisation is off."""
        if self.own is None:
            return self.spark.createDataFrame([], personal.ROW)
        return self.own.view(self.settings.personalized).where(F.col("user").eqNullSafe(F.lit(self.user)))

    def costs(self) -> C.Confusion | None:
        """Costs that the user's corrections have shifted; None where there are none."""
        found = correct.learned_costs(self.learned().where("part = 'confusion'"))
        return found if found.counts else None

    def record(self, events: DataFrame, batch: int) -> bool:
        """Learn from accepts, corrections and undos (user, seq, kind, source, target); not while personalisation is off."""
        return self.own is not None and self.settings.personalized and self.own.learn(personal.learned(events), batch)

    def personalization_state(self) -> DataFrame:
        """(user, json) as a file holds it."""
        return personal.saved(self.learned())

    def set_active_documents(self, versions: DataFrame, accepted: DataFrame) -> None:
        """The documents' caches from their versions and what was accepted since, each (doc, seq, text)."""
        self.caches = livecache.rebuilt(versions, accepted)

    def log_prob_in(self, asked: DataFrame) -> DataFrame:
        """asked(doc, w2, w1, w) with log_prob, lifted where the document's cache holds the word often enough."""
        base = self.log_prob(asked)
        if self.caches is None:
            return base
        alone = asked.select("w").distinct().select(F.lit(None).cast("string").alias("w2"), F.lit(None).cast("string").alias("w1"), "w")
        alone = self.log_prob(alone).select("w", F.col("log_prob").alias("alone"))
        own = self.caches.join(self.caches.groupBy("doc").agg(F.sum("c").alias("total")), "doc")
        known = self.model.uni.select("w", F.lit(True).alias("known"))
        df = base.join(alone, "w").join(own, ["doc", "w"], "left").join(known, "w", "left")
        lifted = ngram.cached(F.col("log_prob"), F.col("alone"), F.coalesce("c", F.lit(0)), F.coalesce("total", F.lit(1)), F.coalesce("known", F.lit(False)), self.settings.gamma)
        return df.select(*asked.columns, lifted.alias("log_prob"))

    def candidates(self, asked: DataFrame, k: int = 8) -> DataFrame:
        return correct.candidates(self.model, asked, k, self.settings.beta, self.costs())

    def suggestions(self, asked: DataFrame, k: int | None = None) -> DataFrame:
        """(query_id, position, insert, score): a menu for asked(query_id, typed, w2, w1) that saves most keys, filled up from the word list."""
        k = k or self.settings.suggestions
        found = predict.predicted(self.model, asked, 3 * k, self.settings.beta, self.costs())
        seeds = found.join(asked.select("query_id", "typed"), "query_id").select("query_id", "typed", F.col("w").alias("insert"), F.col("post").alias("score"))
        shown = predict.menu(predict.weighed(seeds), k)
        return shown if self.lexicon is None else predict.topped_up(shown, asked.select("query_id", "typed"), self.lexicon.select("w"), k)

    def decide(self, asked: DataFrame) -> DataFrame:
        """Corrections, but for profanity: neither is a blocked word put right nor one put in. Words that an undo put back stay."""
        found = correct.decide(self.model, asked, list(self.settings.learned), self.settings.beta, self.settings.threshold, self.lexicon, costs=self.costs())
        kept, put = X.is_profane("from", self.settings.allowed), X.is_profane("to", self.settings.allowed)
        listed = self.learned().where("part = 'learn'").select(F.col("key").alias("word"), F.lit(True).alias("listed")).distinct()
        found = found.withColumn("word", F.lower("from")).join(listed, "word", "left").withColumn("listed", F.coalesce("listed", F.lit(False)) & (F.col("reason") != "too-short"))
        reason = F.when(F.col("listed"), "learn-listed").when(F.col("correct") & kept, "profanity-kept").when(F.col("correct") & put, "profanity-target").otherwise(F.col("reason"))
        fine = F.col("correct") & ~kept & ~put & ~F.col("listed")
        return found.select("query_id", fine.alias("correct"), "from", F.when(fine, F.col("to")).otherwise(F.col("from")).alias("to"), reason.alias("reason"))

    def evaluate(self, words: DataFrame, k: int = 5) -> DataFrame:
        return correct.evaluated(self.model, words, k)

    def embed(self, docs: DataFrame, vectors: DataFrame, id_col: str) -> DataFrame:
        return wordvectors.embedded(docs, vectors, id_col)

    def rarities(self, words: DataFrame) -> DataFrame:
        """words(w) with their rarity by the model's ranks."""
        ranks = wordvectors.ranked(self.model.uni)
        size = ranks.agg((F.count("*") + 1).alias("size"))
        return words.join(ranks, "w", "left").join(F.broadcast(size)).select("w", wordvectors.rarity(F.col("id"), F.col("size")).alias("rarity"))

    def respace(self, asked: DataFrame) -> DataFrame:
        """Joined or moved spaces, but for those that make a blocked word."""
        return correct.respace(self.model, asked).where(~X.is_profane("to", self.settings.allowed))

    def phrases(self, contexts: DataFrame, words: int = 4) -> DataFrame:
        return ngram.beam_phrases(self.model, contexts, words)

    def known_words(self, words: DataFrame) -> DataFrame:
        return words.join(self.model.uni.select("w"), "w", "left_semi")

    def document_frequencies(self, words: DataFrame) -> DataFrame:
        """Null while there is no corpus; 0 for words that it lacks."""
        if self.state is None:
            return words.withColumn("df", F.lit(None).cast("long"))
        return words.join(changes.document_frequency(self.state), "w", "left").withColumn("df", F.coalesce("df", F.lit(0)))

    def pack_global(self, k: int = 24) -> DataFrame:
        return ngram.packed(self.model, k)

    def status(self) -> DataFrame:
        return self.model.sizes()
