"""Training passes over its samples many times, but they are made once."""

from pyspark.sql import functions as F

from cloakframe.operators import samples as SM
from cloakframe.operators import tagger as TG


def test_samples_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    samples = SM.annotated_samples(spark.range(300).withColumnRenamed("id", "k"), "k")
    model = TG.fit(samples.mapInArrow(counted, samples.schema), "k", features=64, iterations=2)
    assert made.value == 300
    assert TG.tag_words(model, samples.filter(F.col("k") < 5), "k").count() > 0
