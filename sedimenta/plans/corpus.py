"""A small invented code base that shows each rule once: path and content of its files. The secrets in it are none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FILES = {
    "src/main/java/com/acme/services/film/FilmController.java": '''/* licence */
package com.acme.services.film;

import java.util.List;

/** Films over HTTP. */
@RestController
@RequestMapping(value = "/films", produces = "application/json")
public class FilmController {
    private static final Logger LOG = LoggerFactory.getLogger("films; {");
    private final FilmService filmService;
    private int calls = 0;

    public FilmController(FilmService filmService) {
        this.filmService = filmService;
    }

    /** One film. */
    @GetMapping("/{id}")
    @Secured({"ROLE_USER", "ROLE_ADMIN"})
    public Film getFilm(final long id) {
        if (id < 0 || id > 10) {
            throw new IllegalArgumentException("a ? b && c");
        }
        return filmService.find(id);
    }

    @PostMapping
    @Secured("ROLE_ADMIN")
    public Film add(Film film, String... tags) {
        return filmService.save(film);
    }

    @DeleteMapping("/{id}/")
    public void remove(long id) {
        calls = calls + 1;
    }
}
''',
    "src/main/java/com/acme/services/film/FilmService.java": '''package com.acme.services.film;

public interface FilmService {
    Film find(long id);

    Film save(Film film);
}
''',
    "src/main/java/com/acme/services/film/FilmServiceImpl.java": '''package com.acme.services.film;

@Service
public class FilmServiceImpl implements FilmService {
    private final FilmRepository filmRepository;
    @Autowired
    private Audit audit;

    @Transactional
    @Cacheable("films")
    public Film find(long id) {
        for (int i = 0; i < 3; i++) {
            while (a() && b()) {
                do {
                    c();
                } while (d());
            }
        }
        return filmRepository.findById(id);
    }

    public Film save(Film film) {
        // TODO: check the film
        switch (film.kind()) {
            case 1:
            case 2:
                audit.log(film);
                break;
            default:
                break;
        }
        int n = switch (film.kind()) {
            case 1, 2 -> 1;
            default -> 0;
        };
        try {
            audit.log(n);
        } catch (Exception e) {
        }
        List<? extends Film> l = n > 0 ? one : two;
        return filmRepository.save(film);
    }
}
''',
    "src/main/java/com/acme/services/film/FilmRepository.java": '''package com.acme.services.film;

public interface FilmRepository extends JpaRepository<Film, Long> {
}
''',
    "src/main/java/com/acme/services/film/FilmEntity.java": '''package com.acme.services.film;

@Entity
@Table(name = "film", schema = "shop")
public class FilmEntity {
}
''',
    "src/main/java/com/acme/common/Clients.java": '''package com.acme.common;

@FeignClient(name = "billing", url = "http://billing.invalid", path = "/v1")
interface Billing {
}

class Listener {
    private KafkaTemplate<String, String> kafka;
    String password = "notreal1";
    String address = "10.0.0.1";

    @KafkaListener(topics = "orders", groupId = "g1")
    public void onOrder(String message) {
        kafka.send("done", message);
        stmt.executeQuery("SELECT " + message);
        MessageDigest.getInstance("MD5");
        new File(request.getParameter("f"));
    }
}

enum Size {
    SMALL("s") { void x() { } }, LARGE("l");

    private final String code;

    Size(String code) {
        this.code = code;
    }

    boolean big() {
        return this == LARGE ? true : false;
    }
}

record Point(int x, int y) {
}

@Entity(name = "thing")
sealed class Thing permits Other {
}
''',
    "src/main/java/com/acme/Broken.java": "package com.acme;\n\nclass Fine { }\n\nclass Broken { void f( {\n",
    "src/test/java/com/acme/FilmControllerTest.java": "package com.acme;\n\nclass FilmControllerTest { }\n",
    "build/Generated.java": "class Generated { }\n",
}


def files(spark: SparkSession) -> DataFrame:
    """All files of the corpus, by path: path, content."""
    return spark.createDataFrame(sorted(FILES.items()), "path string, content string").coalesce(2)


def letters(texts: list[str]) -> list[list[float]]:
    """A vector for each text: how often each letter is in it. It stands for a model of vectors."""
    return [[float(t.lower().count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in texts]
