"""What several test modules share."""


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)
