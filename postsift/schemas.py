"""Fixed schemas of the inputs and results."""

from pyspark.sql import types as T

TWEET = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("content", T.StringType()),
        T.StructField("likeCount", T.LongType()),
        T.StructField("retweetCount", T.LongType()),
        T.StructField(
            "user",
            T.StructType(
                [
                    T.StructField("username", T.StringType()),
                    T.StructField("location", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "place",
            T.StructType(
                [
                    T.StructField("country", T.StringType()),
                    T.StructField("fullName", T.StringType()),
                ]
            ),
        ),
    ]
)

LEXICON = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("rating", T.IntegerType())]
)

#: Columns of one post in the results that list posts.
POST_COLUMNS = ("content", "username", "likeCount", "retweetCount")
