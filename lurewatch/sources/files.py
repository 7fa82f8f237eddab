"""Directory listings on whatever file system a path belongs to."""


def _file_system(spark, path):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark, path):
    fs, target = _file_system(spark, path)
    return fs.exists(target)


def child_names(spark, path):
    fs, target = _file_system(spark, path)
    if not fs.exists(target):
        return []
    return [status.getPath().getName() for status in fs.listStatus(target)]


def remove(spark, path):
    """Remove a folder with all it holds; a missing one is no error."""
    fs, target = _file_system(spark, path)
    fs.delete(target, True)
